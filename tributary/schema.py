"""Roles of the columns of an event table and the column order they imply."""

from __future__ import annotations

from dataclasses import dataclass, field


def _unique(names) -> list[str]:
    return list(dict.fromkeys(names))


@dataclass(frozen=True)
class EventSchema:
    """Which columns identify, describe and label an event.

    ``index`` names the entity (and sub-entity) columns; they order the events but never
    become tokens. ``tie`` makes the event order total: without it two events of the same
    minute could swap places between runs.
    """

    index: list[str]
    tie: list[str]
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    raw: list[str] = field(default_factory=list)
    minutes: str = "total_minutes"
    entity: str | None = None

    def __post_init__(self):
        if not self.index:
            raise ValueError("an event schema needs at least one index column")
        if not self.tie:
            raise ValueError("an event schema needs tie columns that make the event order total")

    @property
    def all_cols(self) -> list[str]:
        """Index, categorical, numeric, binary and label columns, first mention wins."""
        return _unique(self.index + self.categorical + self.numeric + self.binary + self.label)

    @property
    def data_cols(self) -> list[str]:
        """Columns that become tokens; the position in this list is the column id."""
        return [c for c in self.all_cols if c not in self.index]

    @property
    def col_ids(self) -> dict[str, int]:
        return {c: i for i, c in enumerate(self.data_cols)}

    @property
    def n_cols(self) -> int:
        """Tokens per event: the data columns and the row marker."""
        return len(self.data_cols) + 1

    @property
    def sequence_key(self) -> str:
        """Column whose events form one sequence (the first index column by default)."""
        return self.entity or self.index[0]

    @property
    def order(self) -> list[str]:
        """Total order of the events of one sequence key."""
        return _unique([c for c in self.index if c != self.sequence_key] + [self.minutes] + self.tie)

    @property
    def gap_order(self) -> list[str]:
        """Total order of the events of one full index key."""
        return _unique([self.minutes] + self.tie)

    def label_position(self, name: str | None = None) -> int:
        """Column id of a label; the last data column when no name is given."""
        if name is None:
            return self.n_cols - 2
        return self.col_ids[name]

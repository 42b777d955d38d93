"""Event logs to model-ready sequences, and scored sequences to reports, on Spark."""

from tributary.schema import EventSchema

__all__ = ["EventSchema"]

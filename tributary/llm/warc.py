"""WARC archives of crawled pages, and their capture index by an external merge of sorted runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import Scratch, small

#: Shorter payloads are never revisits. Most bytes of an archive file, unless one record has more. Captures in one range of the index.
LEAST_BYTES, FILE_BYTES, RANGE_ROWS = 1000, 32 << 20, 50_000
#: Records and captures in one batch.
SLICE = 5_000
#: Fixed values of the format.
VERSION, END, PROFILE = "WARC/1.1", "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query, lower-cased; empty for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^.*?://", "")
    host, path = F.regexp_extract(rest, "^[^/?#]*", 0), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1)
    return F.lower(F.concat(F.concat_ws(",", F.reverse(F.split(host, "[.]"))), F.lit(")"), path))


def captures(pages: DataFrame, scratch: Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """Every page with its payload, digest, record type and the page it refers to.

    Of equal payloads of at least ``least`` bytes that with the largest page_id is the response (equal ids: all of them).
    Without a capture time in the table, a page's number counts the seconds from 2024-01-01.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary")),
                             "date": F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    rows = rows.withColumn("urlkey", F.trim(F.regexp_replace(url_key(F.col("url")), "[\\r\\n]", " ")))
    copies = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    copies = small(scratch.save(copies.where("n > 1").select("digest", "latest"), "copies"))
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return rows.join(copies, "digest", "left").withColumn("refers_to", F.when(revisit, F.col("latest"))).drop("latest")


def record(row: DataFrame) -> Column:
    """The text of a record without the two line ends that follow it."""
    line = "\r\n"
    clean = lambda c: F.regexp_replace(c, "[\\r\\n]", " ")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + line + "Content-Type: text/html; charset=utf-8" + line + "Content-Length: "), number("payload_bytes"), F.lit(END))
    is_revisit = F.col("refers_to").isNotNull()
    block = F.when(is_revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit(f"{VERSION}{line}WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"), number("page_id"), F.lit(f">{line}WARC-Date: "), "date",
        F.lit(f"{line}WARC-Target-URI: "), clean(F.col("url")), F.lit(f"{line}URL-Key: "), "urlkey", F.lit(f"{line}WARC-Payload-Digest: sha1:"), "digest",
        F.when(is_revisit, F.concat(F.lit(f"{line}WARC-Profile: {PROFILE}{line}WARC-Refers-To: <urn:page:"), number("refers_to"), F.lit(">"))).otherwise(""),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(head, block)


def slot_rows(most: int):
    """Numbers the files of a task: a record that would take a file beyond ``most`` bytes begins the next one."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = 0, 0
        for batch in batches:
            slots = []
            for size in pc.binary_length(batch.column("value").cast(pa.large_string())).to_pylist():
                if held and held + size + len(END) > most:
                    slot, held = slot + 1, 0
                held += size + len(END)
                slots.append(slot)
            yield pa.record_batch([*batch.columns, pa.array(slots, pa.int32())], names=[*batch.schema.names, "slot"])
    return rows


def write_archives(rows: DataFrame, path: str, most: int = FILE_BYTES) -> None:
    """WARC files of ``captures`` rows, of at most ``most`` bytes each unless a single record has more; the records of each file are sorted
    by URL key, time and page. Records are dealt to files as tasks read them, so nothing is shuffled."""
    order = ["urlkey", "date", "page_id"]
    made = rows.select(record(rows).alias("value"), *order)
    dealt = made.mapInArrow(slot_rows(most), T.StructType([*made.schema.fields, T.StructField("slot", T.IntegerType())]))
    dealt.sortWithinPartitions("slot", *order).select("value", "slot").write.partitionBy("slot").option("lineSep", END).text(path)


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of an archive."""
    at, mark = 0, END.encode()
    while at < len(data):
        stop = data.index(mark, at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        begin = stop + len(mark)
        end = begin + int(fields["Content-Length"])
        yield at, fields, data[begin:end]
        at = end + len(mark)


CAPTURE = pa.schema([("urlkey", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("file", pa.string())])
CAPTURE_DDL = ("urlkey string, date string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
               "offset long, file string")


def page_number(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def order(capture: dict) -> tuple:
    """Sort key of a capture: URL key, time, page; a missing number first, as Spark sorts it."""
    page = capture["page_id"]
    return capture["urlkey"], capture["date"], page is not None, page or 0


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive, a sorted run, read back from its records."""
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            file, found = "/".join(path.split("/")[-2:]), []
            for at, fields, block in records(data):
                http, payload = block.split(END.encode(), 1)
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                digest, target = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields.get("WARC-Refers-To")
                if target is None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: the payload at byte {at} is not what was written")
                found.append({"urlkey": fields["URL-Key"], "date": fields["WARC-Date"], "page_id": page_number(fields["WARC-Record-ID"]),
                              "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
                              "refers_to": page_number(target) if target else None, "offset": at, "file": file})
                if len(found) == SLICE:
                    yield pa.RecordBatch.from_pylist(found, schema=CAPTURE)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=CAPTURE)


class LoserTree:
    """Merges sorted lists: inner nodes keep the loser of their match, so the next winner takes one match per level."""

    def __init__(self, runs: list[list[dict]]):
        self.runs, self.place = runs, [0] * len(runs)
        self.heads = [self.head(i) for i in range(len(runs))]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for i in range(len(runs)):
            self.replay(i)

    def head(self, run: int) -> tuple | None:
        return (order(self.runs[run][self.place[run]]), run) if self.place[run] < len(self.runs[run]) else None

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def replay(self, winner: int) -> None:
        """Matches from a leaf up; a node met for the first time keeps its visitor until the other side comes."""
        at = (winner + self.size) // 2
        while at:
            held = self.losers[at]
            if held < 0:
                self.losers[at] = winner
                return
            if self.beats(held, winner):
                self.losers[at], winner = winner, held
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[dict]:
        while self.runs:
            run = self.losers[0]
            if self.heads[run] is None:
                return
            yield self.runs[run][self.place[run]]
            self.place[run] += 1
            self.heads[run] = self.head(run)
            self.replay(run)


def merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of one range in order. Its rows come run by run; the tree merges their keys, and the rows are taken in its order."""
    table = pa.Table.from_batches(batches, schema=CAPTURE)
    keys = [{"urlkey": u, "date": d, "page_id": p, "at": i} for i, (u, d, p) in enumerate(zip(*(table.column(c).to_pylist() for c in ("urlkey", "date", "page_id")), strict=True))]
    runs: dict[str, list[dict]] = {}
    for file, one in zip(table.column("file").to_pylist(), keys, strict=True):
        runs.setdefault(file, []).append(one)
    places = pa.array([one["at"] for one in LoserTree(list(runs.values()))], pa.int64())
    yield from table.take(places).combine_chunks().to_batches(max_chunksize=SLICE)


def capture_index(spark, path: str, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all archives under ``path``, globally ordered by URL key, time and page.

    Every archive is a sorted run. The captures, without payloads, are dealt to ranges of about ``range_rows``; in each range the parts of
    the runs are merged by a loser tree; ranges follow each other. A task holds one file, or one range of captures.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = scratch.save(files.mapInArrow(run_rows, CAPTURE_DDL), "runs")
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "urlkey", "date", "page_id", "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(merged_rows, CAPTURE_DDL)


def archived(pages: DataFrame, scratch: Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC archives in the shared folder and returns the index read back from them:
    urlkey, date, page_id, payload_bytes, payload_digest, record_type, refers_to, offset, file.

    Null html is an empty payload, a null url an empty one, line ends in a url become spaces; a null page_id stays null and never
    takes part as the largest id unless all are null; repeated rows are records of their own; other columns are ignored; an
    empty table gives an empty index. Digests of responses are recomputed from the payloads read, and a difference raises.
    """
    rows = captures(pages, scratch, least)
    path = scratch.path("warc")
    write_archives(rows, path)
    return capture_index(pages.sparkSession, path, scratch)

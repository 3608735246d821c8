"""Splitting CSV files into records by byte ranges, line breaks in quotes included.

A line break ends a record only outside quotes, and whether a byte range begins inside quotes depends on
everything before it. Ranges are moved to line starts, where a reader either is at the start of a
record or in quotes. Each range is scanned for both cases: it is a function from its first state to
its last, and composing the functions of the ranges before it, a window over a few numbers a range, gives
the state it truly begins in. Then each range is read by a task of its own, from the first record that
begins in it to the end of the last one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landspan.sources.csv_dialect import Dialect
from landspan.sources.files import listing, read_at, spread
from landspan.workspace import materialize

RANGE_BYTES = 32 << 20
# Bytes read at once beyond a range, to find its end; each next read doubles.
AHEAD_BYTES = 1 << 16
SUFFIXES = ("csv", "tsv", "txt")


class Quotes:
    """Finds quoted values; a quote opens one only at the start of a field."""

    def __init__(self, separator: str, quote: str):
        sep, q = re.escape(separator.encode()), re.escape(quote.encode())
        rest = rb"[^%b]*(?:%b%b[^%b]*)*(?:%b|\Z)" % (q, q, q, q, q)
        self._quote = quote.encode()
        self._value = re.compile(rb"(?:(?<=[%b\n])|\A)%b%b" % (sep, q, rest))
        self._rest = re.compile(rest)

    def spans(self, data: bytes, inside: bool) -> tuple[np.ndarray, bool]:
        """(start, end) of the quoted values of bytes at a line start, and whether the last is open.

        inside: the bytes begin within a quoted value.
        """
        found, at = [], 0
        if inside:
            at = self._rest.match(data).end()
            found.append((0, at))
        found.extend(match.span() for match in self._value.finditer(data, at))
        spans = np.array(found, np.int64).reshape(-1, 2)
        if not found or found[-1][1] < len(data):
            return spans, False
        # A value that reaches the end of the data is closed there by an odd run of quotes.
        body = data[found[-1][0] + (not inside or len(found) > 1):]
        return spans, (len(body) - len(body.rstrip(self._quote))) % 2 == 0

    def line_ends(self, data: bytes, inside: bool) -> np.ndarray:
        """Places behind line breaks that end a record."""
        spans, _ = self.spans(data, inside)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        if len(spans):
            at = np.searchsorted(spans[:, 0], breaks, "right") - 1
            breaks = breaks[(at < 0) | (breaks >= spans[at, 1])]
        return breaks + 1


def ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """(path, length, number) of the ranges of listed files."""
    return files.where("length > 0").select("path", "length", F.explode(
        F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {range_bytes}"))).alias("number"))


def _line_start(path: str, at: int, length: int) -> int:
    """The first line start at or behind a place."""
    if at <= 0:
        return 0
    size, place = AHEAD_BYTES, at - 1
    while place < length:
        found = read_at(path, place, size).find(b"\n")
        if found >= 0:
            return place + found + 1
        place, size = place + size, size * 2
    return length


def _scan(separator: str, quote: str, range_bytes: int):
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("length", pa.int64()),
                        ("from_out", pa.bool_()), ("from_in", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(separator, quote)
        for batch in batches:
            for row in batch.to_pylist():
                first = row["number"] * range_bytes
                start = _line_start(row["path"], first, row["length"])
                stop = _line_start(row["path"], min(first + range_bytes, row["length"]), row["length"])
                if start >= stop:  # no line starts here
                    continue
                data = read_at(row["path"], start, stop - start)
                ends = [False, True] if quote.encode() not in data else [
                    quotes.spans(data, inside)[1] for inside in (False, True)]
                yield pa.RecordBatch.from_pylist(
                    [{"path": row["path"], "start": start, "stop": stop, "length": row["length"],
                      "from_out": ends[0], "from_in": ends[1]}], schema)

    return scan


def with_first_state(scanned: DataFrame) -> DataFrame:
    """Add whether a range begins inside quotes.

    A range keeps the state, turns it, or ends in one state whatever it begins in. The state is that
    of the last range of the third kind, or outside at the file's start, turned once for each range since
    that turns it.
    """
    fixed = F.col("from_out") == F.col("from_in")
    turns = F.when(~fixed & F.col("from_out"), 1).otherwise(0)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = scanned.withColumn("turns", turns).withColumn(
        "all_turns", F.coalesce(F.sum("turns").over(before), F.lit(0))).withColumn(
        # What the fixed range leaves behind, and the turns counted up to it.
        "last", F.max(F.when(fixed, F.struct("start", "from_out", F.col("all_turns").alias("turned")))).over(before))
    since = F.col("all_turns") - F.coalesce(F.col("last.turned"), F.lit(0))
    first = F.coalesce(F.col("last.from_out"), F.lit(False)).cast("int")
    return known.select("path", "start", "stop", "length", ((first + since) % 2 == 1).alias("inside"))


def _read(separator: str, quote: str, encoding: str):
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes = Quotes(separator, quote)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _records(row, quotes)

    def _records(row: dict, quotes: Quotes) -> Iterator[pa.RecordBatch]:
        path, start, size = row["path"], row["start"], row["stop"] - row["start"]
        data = read_at(path, start, size)
        ends = quotes.line_ends(data, row["inside"])
        if row["inside"] and not len(ends):  # all of it belongs to a record that began before
            return
        ahead = AHEAD_BYTES
        # The last record goes on in the ranges behind.
        while not (len(ends) and ends[-1] >= size) and start + len(data) < row["length"]:
            data += read_at(path, start + len(data), ahead)
            ahead = max(2 * ahead, len(data))
            ends = quotes.line_ends(data, row["inside"])
        begins, stops = np.append(0, ends), np.append(ends, len(data))
        if row["inside"]:
            begins, stops = begins[1:], stops[1:]
        for at in range(0, len(begins), 8192):
            found = []
            for begin, stop in zip(begins[at:at + 8192].tolist(), stops[at:at + 8192].tolist()):
                if begin >= size:  # begins in a later range
                    break
                text = data[begin:stop]
                if start + begin == 0 and text.startswith(b"\xef\xbb\xbf"):
                    text = text[3:]
                text = text.removesuffix(b"\n").removesuffix(b"\r")
                if text:
                    found.append({"path": path, "offset": start + begin, "record": text.decode(encoding)})
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

    return read


def split(spark: SparkSession, path: str, separator: str, quote: str, encoding: str = "UTF-8",
          range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, record) of all records of a file or of the files below a folder.

    The encoding must write line breaks, separators and quotes as ASCII does. Empty lines are no records.
    """
    if len("\n".encode(encoding)) != 1:
        raise ValueError(f"a file in {encoding} can't be split at bytes")
    together = RANGE_BYTES // range_bytes
    pieces = spread(ranges(listing(spark, path, *SUFFIXES), range_bytes), "path", "number", together=together)
    scanned = materialize(pieces.mapInArrow(
        _scan(separator, quote, range_bytes), "path string, start long, stop long, length long, from_out boolean,"
        " from_in boolean"), "csv-ranges")
    return spread(with_first_state(scanned), "path", "start", together=together).mapInArrow(
        _read(separator, quote, encoding), "path string, offset long, record string")


def samples(spark: SparkSession, path: str, encoding: str, size: int, files: int) -> list[tuple[str, bool]]:
    """The first bytes of the first files, cut at a line's end, and whether that is all of a file."""
    out = []
    for row in listing(spark, path, *SUFFIXES).where("length > 0").orderBy("path").limit(files).collect():
        data = read_at(row["path"], 0, size)
        whole = row["length"] <= size
        out.append((data.removeprefix(b"\xef\xbb\xbf").decode(encoding, "ignore" if not whole else "strict"), whole))
    return out


def fields(rows: DataFrame, dialect: Dialect) -> DataFrame:
    """The fields c0, c1, ... of records as text, and `odd` where their number isn't the dialect's."""
    names = [f"c{i}" for i in range(dialect.width)]
    schema = ", ".join(f"{n} string" for n in [*names, "odd"])
    options = {"sep": dialect.separator, "quote": dialect.quote, "escape": dialect.quote, "multiLine": "true",
               "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "odd"}
    parsed = rows.withColumn("parsed", F.from_csv("record", schema, options))
    return parsed.select("path", "offset", "record", *[F.col(f"parsed.{n}").alias(n) for n in names],
                         F.col("parsed.odd").isNotNull().alias("odd"))

"""SimHash near-duplicates with pigeonring filtering (operator 8).

A text becomes lower-case (A-Z) words between white space, its word shingles, and 64 bits: a
bit is 1 if it is set in over half the shingles' XXH64 hashes.

Two fingerprints that differ in at most 2 of 64 bits, cut into a ring of 3 segments, have by the
pigeonring principle a chain of consecutive segments that stays in proportion: its first segment
does not differ, its first two in 1 bit at most, all three in 2. So they agree in one segment and
in one half of the next: 32 bits, six ways. Only fingerprints that meet there are looked at, the
chain is checked, then the full Hamming distance.

Copies are one fingerprint from the start. Where more than ``BUCKET`` fingerprints meet, pairs
are not formed: each of them is listed under itself and its 64 neighbours at one bit. Two at
distance 2 or less share an entry, and those of an entry (65 at most) are tied to its least.

A null text counts as empty. Texts without words have fingerprint zero and link like others.
Null ids take part; a component of null ids only has a null id. Repeated rows are kept. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.llm.components import components
from landspan.llm.tables import BATCH_ROWS
from landspan.workspace import materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 2
# Fingerprints of a bucket that are compared in pairs.
BUCKET = 32
# First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text, unsigned."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1:].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last)),
                         "<u8", len(last))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k:k + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, bits (signed long) for each document row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(begin, BATCH_ROWS)
                bits = np.array([fingerprint(x, shingle) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, bits long")


def _segment(bits: Column, k: int) -> Column:
    first, width = SEGMENTS[k % 3]
    return F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(bits: Column) -> Column:
    """The six places where a fingerprint may meet a close one."""
    keys = []
    for k in range(3):
        following = _segment(bits, k + 1)
        for half, part in enumerate((F.shiftrightunsigned(following, 11),
                                     following.bitwiseAND(F.lit(2047).cast("long")))):
            keys.append(F.lit((2 * k + half) << 48).cast("long").bitwiseOR(
                F.shiftleft(_segment(bits, k), 12)).bitwiseOR(part))
    return F.array(*keys)


def _chained(a: Column, b: Column) -> Column:
    """Whether a chain of segments stays within its budgets."""
    differ = [F.bit_count(_segment(a, k).bitwiseXOR(_segment(b, k))) for k in range(3)]
    out = F.lit(False)
    for k in range(3):
        out = out | ((differ[k] == 0) & (differ[(k + 1) % 3] <= 1))
    return out


def close_pairs(nodes: DataFrame) -> DataFrame:
    """u, v: links that connect all fingerprints at distance 2 or less.

    nodes: bits, distinct.
    """
    placed = nodes.select("bits", F.explode(_keys(F.col("bits"))).alias("place"))
    shared = placed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(placed.join(shared, "place"), "simhash-places")
    few = met.where(F.col("n") <= BUCKET).select("place", "bits")
    a, b = F.col("a.bits"), F.col("b.bits")
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.place") == F.col("b.place")) & (a < b)).where(
        _chained(a, b) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)).select(a.alias("u"), b.alias("v"))
    crowd = met.where(F.col("n") > BUCKET).select("bits").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")
                                             for k in range(64)])
    listed = crowd.select("bits", F.explode(F.transform(
        flips, lambda f: f.bitwiseXOR(F.col("bits")))).alias("entry"))
    hubs = listed.groupBy("entry").agg(
        F.min("bits").alias("hub"), F.collect_set("bits").alias("near")).where(F.size("near") > 1)
    return pairs.unionByName(
        hubs.select(F.explode("near").alias("u"), F.col("hub").alias("v")).where("u != v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, bits, component_id, root (a fingerprint of the component) per document row."""
    rows = materialize(fingerprints(docs, shingle), "simhash")
    nodes = rows.groupBy("bits").agg(F.min("doc_id").alias("least"))
    roots = components(close_pairs(nodes.select("bits"))).withColumnRenamed("node", "bits")
    placed = materialize(nodes.join(roots, "bits", "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")), "simhash-roots")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(named, "root").select("bits", "component_id", "root"), "bits").select(
        "doc_id", "bits", "component_id", "root")


def _bits(text: Column) -> Column:
    @F.arrow_udf("long")
    def bits(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x.as_py()) for x in texts], np.uint64).view(np.int64))

    return bits(text)


def keep_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component the row of the least doc_id. found: doc_id, bits, root of each row.

    Of rows that share the id and the fingerprint one is kept, so each component keeps one row,
    also if other components hold its id or all its ids are null. All columns stay.
    """
    row = F.struct("doc_id", "bits")
    kept = found.groupBy("root").agg(F.coalesce(
        F.min(F.when(F.col("doc_id").isNotNull(), row)), F.min(row)).alias("kept")).select(
        F.coalesce("kept.doc_id", F.lit(0).cast("long")).alias("_kept_id"),
        F.isnull("kept.doc_id").alias("_kept_none"), F.col("kept.bits").alias("_kept_bits"))
    # An id alone doesn't name a row. One shuffle of the texts serves the join and the repeated rows.
    keys = ["_kept_id", "_kept_none", "_kept_bits"]
    return docs.withColumns({
        "_kept_id": F.coalesce("doc_id", F.lit(0).cast("long")), "_kept_none": F.isnull("doc_id"),
        "_kept_bits": _bits(F.coalesce("text", F.lit("")))}).join(
        kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without near-duplicates as operator 8 finds them."""
    return keep_rows(docs, near_duplicates(docs))


def op8_simhash_components(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")

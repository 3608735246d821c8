"""Document fingerprints: invertible Bloom lookup sketches (operator 7), DataFrame functions only.

A paragraph is a line. Its digest is 64 bits that carry their own check: 24 bits are a hash of
the other 40; the k-th copy of a paragraph in a text has a digest of its own. A digest goes to
one cell of each of three tables, and a cell holds the exclusive or of its digests. Two sketches
of one size subtract cell by cell: what both texts share cancels. A cell whose content passes
the check holds one differing digest; it is noted, taken out of its cells, and so on until all
cells are empty (peeling). When cells remain, both sketches are made again four times larger.

Only cells that are not empty are kept, so the cost of a sketch doesn't depend on its size.

The likeness of two texts is 1 - d / (a + b), for d differing digests of a and b. If no size
peels, which takes digests that agree in 64 bits, the difference is counted from the digests.

Null texts are empty; an empty text has one empty paragraph. Documents are in descending order
of doc_id, null ids last, equal ids by the hash of the text. Repeated rows have rows of their
own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# log2 of the cells of each of three tables of a fingerprint, and how often a failed peeling is
# tried again with four times as many.
FIRST_BITS, RETRIES = 4, 9
ROUNDS = 16
CHECK_BITS = 24
# Rows of a bucket of consecutive documents, buckets at most, and of them those cut by quantiles.
BUCKET_ROWS, MAX_BUCKETS, QUANTILES = 2000, 100_000, 1000

_CELLS = "array<struct<cell:bigint,held:bigint>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _checked(digest: Column) -> Column:
    """A digest whose low bits are a hash of the others."""
    body = F.shiftrightunsigned(digest, CHECK_BITS)
    low = F.xxhash64(body).bitwiseAND(F.lit((1 << CHECK_BITS) - 1).cast("long"))
    return F.shiftleft(body, CHECK_BITS).bitwiseOR(low)


def _run_starts(ordered: Column, differs: Callable[[Column, Column], Column]) -> Column:
    """Places (from 1) at which a run of equals begins in a sorted array that isn't empty."""
    return F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda p: (p == 1) | differs(
        F.element_at(ordered, p), F.element_at(ordered, F.greatest(p - 1, F.lit(1)))))


def digests(text: Column) -> Column:
    """Digests of the paragraphs of a text; never empty, all different."""
    plain = F.array_sort(F.transform(F.split(text, "\n"), lambda line: F.xxhash64(line)))

    def numbered(s: Column) -> Column:
        # How many equal ones stand before: by the start of the run they belong to.
        return F.transform(s, lambda d, i: _checked(F.xxhash64(
            d, (i + 1 - F.array_position(s, d)).cast("long"))))

    return _let(plain, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), F.transform(
        s, lambda d: _checked(F.xxhash64(d, F.lit(0).cast("long"))))).otherwise(numbered(s)))


def _entries(keys: Column, bits: Column) -> Column:
    """The three cells of each digest."""
    def cell(d: Column, table: int) -> Column:
        turned = d if table == 0 else F.shiftleft(d, 21 * table).bitwiseOR(
            F.shiftrightunsigned(d, 64 - 21 * table))
        # Shift by 64 - bits, in two steps as the amount is a column.
        place = F.call_function("shiftrightunsigned", turned, F.lit(64) - bits)
        return F.struct((place + F.lit(table << 40)).alias("cell"), d.alias("held"))

    return F.flatten(F.transform(keys, lambda d: F.array(*[cell(d, t) for t in range(3)])))


def _merge(cells: Column) -> Column:
    """Contents of equal cells combined, empty cells left out."""
    def combined(s: Column) -> Column:
        starts = _run_starts(s, lambda a, b: a["cell"] != b["cell"])
        return _let(starts, lambda at: F.filter(F.transform(at, lambda p, i: F.struct(
            F.element_at(s, p)["cell"].alias("cell"),
            F.aggregate(F.slice(s, p, F.coalesce(F.get(at, i + 1), F.size(s) + 1) - p),
                        F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(e["held"])).alias("held"))),
            lambda e: e["held"] != 0))

    return _let(F.array_sort(cells), lambda s: F.when(F.size(s) == 0, s).otherwise(combined(s)))


def sketch(keys: Column, bits: Column) -> Column:
    """Cells of a set of digests, three tables of 2**bits cells."""
    return _merge(_entries(keys, bits))


def peel(cells: Column, bits: Column) -> Column:
    """Differing digests that a difference of sketches holds; null if cells remain."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(
            state["cells"], lambda e: e["held"] == _checked(e["held"])), lambda e: e["held"]))
        taken = _let(pure, lambda k: F.struct(
            _merge(F.concat(state["cells"], _entries(k, bits))).alias("cells"),
            F.concat(state["found"], k).alias("found")))
        return F.when(F.size(state["cells"]) == 0, state).otherwise(taken)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step,
                       lambda s: F.when(F.size(s["cells"]) == 0, s["found"]))


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Differing digests of two texts, from their fingerprints, then from larger sketches."""
    first = peel(_merge(F.concat(sketch_a, sketch_b)), F.lit(FIRST_BITS))

    def again(found: Column, level: Column) -> Column:
        bits = (level * 2 + FIRST_BITS).cast("int")
        return F.when(found.isNotNull(), found).otherwise(
            peel(_merge(F.concat(sketch(a, bits), sketch(b, bits))), bits))

    peeled = _let(first, lambda found: F.when(found.isNotNull(), found).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.lit(RETRIES)), F.lit(None).cast("array<bigint>"), again)))
    return F.coalesce(peeled, F.array_union(F.array_except(a, b), F.array_except(b, a)))


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """1 for equal sets of paragraphs, 0 for sets that share none."""
    return 1 - F.size(difference(a, b, sketch_a, sketch_b)) / (F.size(a) + F.size(b))


def _as_text(keys: Column, cells: Column) -> Column:
    parts = F.transform(cells, lambda e: F.concat(
        F.lower(F.hex(F.shiftrightunsigned(e["cell"], 36).bitwiseOR(
            e["cell"].bitwiseAND(F.lit((1 << FIRST_BITS) - 1).cast("long"))))), F.lit("="),
        F.lower(F.hex(e["held"]))))
    return F.concat_ws(";", F.size(keys).cast("string"), parts)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each document with the one after it in descending order of id.

    Documents are dealt into buckets of consecutive ids: quantiles cut the ids, each interval is
    cut evenly. The first document of a bucket also stands at the end of the bucket before, so
    texts move once and no task sees more than a bucket. After the last comes the first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    buckets = min(max(1, -(-n // BUCKET_ROWS)), MAX_BUCKETS)
    cuts = min(buckets, QUANTILES)
    inner = -(-buckets // cuts)
    edges = [0] if low is None else [low, high + 1]
    if cuts > 1:
        middle = rows.agg(F.percentile_approx("doc_id", [k / cuts for k in range(1, cuts)], 100 * cuts)
                          ).first()[0]
        edges = sorted({*edges, *middle})
    limits = F.array(*[F.lit(e).cast("long") for e in reversed(edges)])
    # Number of limits above the id: 1 for the highest interval.
    above = F.size(F.filter(limits, lambda e: e > F.col("doc_id")))
    upper, lower = F.element_at(limits, above), F.element_at(limits, F.least(above + 1, F.size(limits)))
    part = F.least(F.floor((upper - 1 - F.col("doc_id")) / F.greatest(upper - lower, F.lit(1)) * inner),
                   F.lit(inner - 1))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(edges) * inner)).otherwise(
        above * inner + part).cast("long")
    keyed = rows.select("doc_id", "text", bucket.alias("bucket"), F.xxhash64("text").alias("tie"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), -F.col("doc_id"), F.col("tie"))
    firsts = keyed.groupBy("bucket").agg(F.min(order).alias("place"), F.min_by(
        F.struct(F.col("doc_id").alias("first_id"), F.col("tie").alias("first_tie")), order).alias("first"))
    # As many rows as buckets, MAX_BUCKETS at most.
    line = Window.orderBy("bucket")
    ends = firsts.select("first.*", F.coalesce(
        F.lag("bucket").over(line), F.max("bucket").over(
            line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end_of"))
    ends = keyed.drop("bucket").join(
        F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    ).select("doc_id", "text", F.col("end_of").alias("bucket"), "tie").dropDuplicates(["bucket"])
    both = keyed.withColumn("extra", F.lit(False)).unionByName(ends.withColumn("extra", F.lit(True)))
    following = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), "tie")
    return both.withColumn("next_text", F.lead("text").over(following)).where(~F.col("extra")).select(
        "doc_id", "text", "next_text")


def compare_versions(pairs: DataFrame) -> DataFrame:
    """Fingerprints and likeness of doc_id, text, edited, next_text."""
    bits = F.lit(FIRST_BITS)
    made = pairs.withColumns({f"{name}_keys": digests(F.col(column)) for name, column in (
        ("own", "text"), ("edited", "edited"), ("next", "next_text"))}).drop("next_text")
    made = made.withColumns({f"{name}_cells": sketch(F.col(f"{name}_keys"), bits)
                             for name in ("own", "edited", "next")})
    near = lambda name: likeness(
        F.col("own_keys"), F.col(f"{name}_keys"), F.col("own_cells"), F.col(f"{name}_cells"))
    return made.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        _as_text(F.col("own_keys"), F.col("own_cells")).alias("fingerprint"),
        _as_text(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"), near("next").alias("near_next"))


def op7_iblt_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    pairs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    return compare_versions(pairs.withColumn("edited", edited))

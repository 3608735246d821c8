"""Mixing sources to target weights by weighted fair queueing (operator 13).

A source's share of the mix is its target, in words. Its documents are shuffled (ordered by a hash
of their key) and queue one after another, once for each allowed repeat. A document leaves the
queue at its virtual finish time: the words of its source up to and with it, divided by the
source's target. The queue of all sources is sorted by that time over ranges, and the mix is what
leaves it within the total budget: all sources advance in proportion to their targets, so each
stands within about a document of its target when the budget is used up.

Running sums work in two levels. A source of n rows is cut into sqrt(n) parts by its hash; sums run
within a part and over the parts. Rows of one key and text are one counted row until they queue.

Documents are taken whole, each at most `repeats` times. A null text has no words; documents
without words have nothing to take. A null source is a source, the last. Null ids are one key. The
mix depends on the rows only, not on their order or place. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspan.operators.columns import add_feature_id
from landspan.workspace import materialize

SEED = "mix"
# White space that parts words.
SPACE = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\x0c\r"
# Copies of one row that one task expands at once.
COPIES = 4096

_KEY = ["finish", "rank", "turn", "doc_id", "size", "tag", "copy", "repeat"]


def word_count(text: Column) -> Column:
    """Number of runs without white space; the text is shortened in place, no word is listed."""
    marks = F.regexp_replace(F.rtrim(text, F.lit(_SPACES)), f"[{SPACE}]*[^{SPACE}]+", "w")
    return F.coalesce(F.char_length(marks), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """source, doc_id, size, tag, turn (place in the shuffle) and the number of copies."""
    return docs.select(
        "source", "doc_id", word_count(F.col("text")).alias("size"),
        F.xxhash64(F.col("text").isNull(), "text").alias("tag"),
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"), F.md5("text"))), 1, 15),
               16, 10).cast("long").alias("turn"),
    ).groupBy("source", "doc_id", "size", "tag", "turn").agg(F.count(F.lit(1)).alias("copies"))


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """rank, source, rows, source_size, weight and target of each source (source, rows, source_size).

    Targets are `share` of all sizes, dealt by weight; no source gets over `repeats` times its
    size, and what it can't take is dealt again among the others until none is above. Each round
    is one sum over the sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = add_feature_id(
        sources.withColumn("absent", F.col("source").isNull()), "rank", ["absent", "source"])
    ranked = materialize(ranked.drop("absent").withColumn(
        "weight", cycle[((F.col("rank") - 1) % len(weights)).cast("int")]).withColumn(
        "most", F.col("source_size") * float(repeats)), "sources")
    budget = ranked.agg(F.sum("source_size")).first()[0]
    level, above = 0.0, F.lit(False)
    while budget:
        full, weight = ranked.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)),
                                  F.sum(F.when(~above, F.col("weight")).otherwise(0.0))).first()
        if not weight:  # every source gives all it can
            level = float("inf")
            break
        before, level = level, (share * budget - full) / weight
        if level == before:
            break
        above = F.col("weight") * F.lit(level) > F.col("most")
    return ranked.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(level))).drop("most")


def queued(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document row (copy) with `upto`, the words of its source up to and with it."""
    rows = groups.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight")
    parts = F.ceil(F.sqrt("rows"))
    rows = rows.withColumn("part", F.floor(F.col("turn") / F.lit(float(1 << 60)) * parts))
    words = F.col("size") * F.col("copies")
    offsets = rows.groupBy("rank", "part").agg(F.sum(words).alias("words")).select(
        "rank", "part", (F.sum("words").over(Window.partitionBy("rank").orderBy("part").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("words")).alias("offset"))
    within = Window.partitionBy("rank", "part").orderBy("turn", "doc_id", "size", "tag").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.sum(words).over(within) - words).join(offsets, ["rank", "part"])
    # Copies are numbered in two steps, so that very many are dealt to several tasks.
    some = rows.withColumn("bundle", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    copy = F.explode(F.expr(
        f"sequence(bundle * {COPIES}, least(copies, (bundle + 1) * {COPIES}) - 1)")).alias("copy")
    return some.repartition("turn", "tag", "bundle").select("*", copy).select(
        "rank", "source", "doc_id", "size", "tag", "turn", "copy", "source_size", "target",
        (F.col("offset") + F.col("before") + (F.col("copy") + 1) * F.col("size")).alias("upto"))


def _place(repeat: int) -> Column:
    """Where the given repeat of a row stands in the queue."""
    finish = (F.col("upto") + repeat * F.col("source_size")) / F.col("target")
    return F.struct(finish.alias("finish"), *_KEY[1:-1], F.lit(repeat).alias("repeat"))


def first_left(rows: DataFrame, budget: float, repeats: int):
    """Place of the first row beyond the budget in the sorted queue; None if all rows fit."""
    queue = rows.where("size > 0 AND target > 0").select(
        F.explode(F.array(*[_place(r) for r in range(repeats)])).alias("at"), "size")
    # Written once in sorted ranges; a range is summed by one task, and one range is looked into.
    ranges = materialize(queue.select("at.*").repartitionByRange(*_KEY).withColumn(
        "span", F.spark_partition_id()), "queue")
    upto = F.sum("words").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # One row a range.
    spans = ranges.groupBy("span").agg(F.sum("size").alias("words")).select(
        "span", "words", upto.alias("upto"))
    split = spans.where(F.col("upto") > F.lit(budget)).orderBy("span").select(
        "span", F.col("upto") - F.col("words")).first()
    if split is None:
        return None
    order = Window.orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranges.where(F.col("span") == split[0]).withColumn("upto", F.sum("size").over(order) + split[1]).where(
        F.col("upto") > F.lit(budget)).orderBy(*_KEY).select(F.struct(*_KEY).alias("at")).first()[0]


def _literal(place) -> Column:
    kinds = {"finish": "double", "rank": "long", "copy": "long", "repeat": "int"}
    return F.struct(*[F.lit(place[k]).cast(kinds.get(k, "long")).alias(k) for k in _KEY])


def mix(docs: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """Each document row with its source's size and target, and how often the mix takes it.

    docs: doc_id, source, text. weights go round over the sources in code point order, null last;
    the budget is `share` of the words of all documents.
    """
    groups = materialize(keyed(docs), "mix-keys")
    sources = materialize(with_targets(groups.groupBy("source").agg(
        F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("source_size")),
        weights, share, repeats), "mix-targets")
    rows = materialize(queued(groups, sources.withColumnRenamed("source", "of")), "mix-rows")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cut = first_left(rows, min(share, float(repeats)) * total, repeats)
    times = sum((F.when(_place(r) < _literal(cut), 1).otherwise(0) for r in range(repeats)), F.lit(0)) \
        if cut else F.lit(repeats)
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", times.alias("times"))


def op13_source_mix(spark, sf_dir: str) -> DataFrame:
    """All documents; sources weigh 5, 2, 1 in turn, the mix has 150 % of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, [5.0, 2.0, 1.0], 1.5, 2)
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("times")).cast("long").alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || md5(concat_ws(':', 'mix', doc_id::VARCHAR, md5(text)))[1:15])::BIGINT AS turn
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2::DOUBLE AS most
  FROM sources
), filled AS (
  -- Sources fill up in the order of what they hold for each weight. The level is that of the first
  -- one that doesn't.
  SELECT *, row_number() OVER (ORDER BY most / weight, rank) AS k,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(most) OVER earlier, 0::DOUBLE))
      / sum(weight) OVER later AS level
  FROM weighed
  WINDOW earlier AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    later AS (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT source, rank, source_size,
    least(most, weight * (SELECT arg_min(level, k) FROM filled WHERE weight * level <= most)) AS target
  FROM weighed
), served AS (
  SELECT row_number() OVER () AS n, doc_id, size, source_size, target, rank, turn,
    sum(size) OVER (PARTITION BY rank ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), queue AS (
  SELECT n, sum(size) OVER (ORDER BY (upto + repeat * source_size)::DOUBLE / target, rank, turn, doc_id, size, repeat
                            ROWS UNBOUNDED PRECEDING) AS total
  FROM served, (VALUES (0), (1)) r(repeat) WHERE size > 0
), times AS (
  SELECT n, count(*) AS times FROM queue
  WHERE total <= 1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE GROUP BY n
)
SELECT doc_id, size, source_size, target, (size * coalesce(times, 0))::BIGINT AS taken
FROM served LEFT JOIN times USING (n)
"""

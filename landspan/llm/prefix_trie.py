"""Prefix trie of conversations (operator 12).

A conversation is a path of turns, each a 16-byte digest of role and text. Paths are sorted over
ranges, so each range is a shard that holds a stretch of the trie in depth-first order. A node
whose conversations lie in several shards is a common prefix of the first path of a shard and the
last path before it. These prefixes, the splitters' *skeleton*, are known to every task; a
shard finishes all other nodes by itself and hands in partial aggregates of skeleton nodes. Those
are added up by node, and one pass over the skeleton, which is as small as the splitters,
completes them from the deepest up.

Paths are cut into pieces of `PIECE` turns, so a row has a bound however long a conversation
is. A piece hangs in a trie of its own below the digest of the pieces before it. Deeper pieces are
done first; what lies below a node at the end of a piece goes up with its smallest member, so there is
one round for each `PIECE` turns of the longest conversation.

Nulls in role or text are empty strings, a null turn comes first, equal turns of a conversation are
ordered by role and text, and repeated rows are turns of their own. Rows without a conversation id
belong to none and are left out. An empty table has no nodes, not even a root. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landspan.workspace import materialize

DIGEST = 16
# Turns of a path in one row.
PIECE = 1024
# Ids of a node that one row holds as text.
IDS = 4096
# Digests of a shard.
SHARD_DIGESTS = 250_000


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that name a turn; the length keeps role and text apart."""
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(said, 256), 1, 2 * DIGEST))


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0 in each conversation), digest and chars of each turn.

    Rows are sorted over ranges, so a very long conversation is numbered by several tasks: each
    counts its own rows and starts where the tasks before it end.
    """
    turns = rows.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text", "copy"]
    turns = turns.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order)
    sorted_ = turns.sortWithinPartitions(*order).select(
        "conv_id", turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.char_length("text").alias("chars"), F.monotonically_increasing_id().alias("at"))
    sorted_ = materialize(sorted_.withColumn("span", F.shiftright("at", 33)), "turns")
    ends = sorted_.groupBy("span", "conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # A conversation has a row for each span it reaches into.
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = ends.select("span", "conv_id", (before - F.col("first")).alias("shift"))
    return sorted_.join(starts, ["span", "conv_id"]).select(
        "conv_id", (F.col("at") + F.col("shift")).alias("place"), "digest", "chars")


def paths(turns: DataFrame, conv_ids: DataFrame, piece: int = PIECE) -> DataFrame:
    """level, conv_id, path, chars, ends of each piece; turnless conversations have one, empty.

    The path of a deeper piece begins with a digest of the pieces before it, whose chars are 0.
    The last piece of a conversation ends it.
    """
    pieces = turns.groupBy("conv_id", F.expr(f"place div {piece}").cast("int").alias("level")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("t")).select(
        "conv_id", "level", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("path"),
        F.col("t.chars").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy("level")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(*[F.unhex(F.lpad(F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "level", "path")).over(earlier)), 16, "0"))
                      for seed in (1, 2)])
    pieces = pieces.select("*", head.alias("head"), F.lead("level").over(order).isNull().alias("ends"))
    whole = pieces.select(
        "level", "conv_id", F.when(F.col("level") > 0, F.concat("head", "path")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("level") > 0, F.concat(F.array(F.lit(0)), "chars")).otherwise(F.col("chars")).alias("chars"),
        "ends")
    empty = conv_ids.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select(
        F.lit(0).alias("level"), "conv_id", F.lit(b"").alias("path"),
        F.array().cast("array<int>").alias("chars"), F.lit(True).alias("ends"))
    return whole.unionByName(empty)


# What a shard hands in: nodes (node set if in the skeleton, parent set if the parent is; via is the
# conversation that brought what lies below the piece), and ids of conversations that end at
# skeleton nodes, in order.
_NODES = ("node binary, parent binary, parent_conv_id long, depth long, conv_id long, n_convs long, n_children long,"
          " n_leaves long, saved_tokens long, chars long, via long, ends_sha256 string, first long, ids binary")
_SCHEMA = pa.schema([(name, {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[kind])
                     for name, kind in (x.split() for x in _NODES.split(", "))])
_NO_IDS = hashlib.sha256().hexdigest()


class _Node:
    __slots__ = ("depth", "name", "chars", "parent", "skeleton", "conv", "n", "children", "leaves", "saved", "ends", "via")

    def __init__(self, name: bytes, chars: int, parent: _Node | None):
        self.depth, self.name = parent.depth + 1 if parent else 0, name
        self.chars, self.parent, self.skeleton = chars, parent, parent is None
        self.conv, self.via, self.ends = None, None, []
        self.n = self.children = self.leaves = self.saved = 0

    def child(self, digest: bytes, chars: int) -> _Node:
        # Chained digests: a node has a name of fixed size, whatever its depth.
        return _Node(hashlib.blake2b(self.name + digest, digest_size=DIGEST).digest(), chars, self)

    def add(self, conv: int):
        self.conv = conv if self.conv is None else min(self.conv, conv)

    def leave(self):
        """Tell the parent. What a skeleton node adds to it is known only when it is complete."""
        self.parent.add(self.conv)
        self.parent.n += self.n
        if not self.skeleton:
            self.leaves += not self.children
            self.saved += (self.n - 1) * self.chars
            self.parent.children += 1
            self.parent.leaves += self.leaves
            self.parent.saved += self.saved


def _shared(a: bytes, b: bytes) -> int:
    """Digests that two paths share at their start, by halving."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST:middle * DIGEST] == b[low * DIGEST:middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def _ids(convs: Iterable[int]) -> bytes:
    return ",".join(map(str, convs)).encode()


def _shard_nodes(rows: Iterator[dict], open_ends: dict[int, tuple[int, int]]) -> list[_Node]:
    """Nodes of one shard, whose rows come in path order.

    Nodes on its first path down to the first of its open_ends, and on its last path down to the
    second, may lie in other shards too.
    """
    stack, left, before, shard = [_Node(b"", 0, None)], [], b"", None
    for row in rows:
        path, depth = row["path"], len(row["path"]) // DIGEST
        keep = _shared(path, before)
        while len(stack) - 1 > keep:
            left.append(stack.pop())
            left[-1].leave()
        for d in range(len(stack), depth + 1):
            stack.append(stack[-1].child(path[(d - 1) * DIGEST:d * DIGEST], row["chars"][d - 1]))
        if shard is None:
            shard = row["shard"]
            for node in stack[:open_ends[shard][0] + 1]:
                node.skeleton = True
        last, before = stack[-1], path
        last.n += 1
        last.add(row["conv_id"])
        if row["ends"]:
            last.ends.append(row["conv_id"])
        if row["up_children"]:
            last.via = row["conv_id"]
            last.children += row["up_children"]
            last.leaves += row["up_leaves"]
            last.saved += row["up_saved"]
    if shard is None:
        return []
    for node in stack[:open_ends[shard][1] + 1]:
        node.skeleton = True
    while len(stack) > 1:
        left.append(stack.pop())
        left[-1].leave()
    return left + stack


def _handed_in(nodes: list[_Node]) -> Iterator[dict]:
    for node in nodes:
        row = {"depth": node.depth, "conv_id": node.conv, "n_convs": node.n, "n_children": node.children,
               "n_leaves": node.leaves, "saved_tokens": node.saved, "chars": node.chars, "via": node.via}
        parent = node.parent
        row |= {"parent": parent.name} if parent and parent.skeleton else {"parent_conv_id": parent.conv if parent else None}
        if not node.skeleton:
            yield row | {"ends_sha256": hashlib.sha256(_ids(node.ends)).hexdigest()}
            continue
        yield row | {"node": node.name}
        for at in range(0, len(node.ends), IDS):
            yield {"node": node.name, "first": node.ends[at], "ids": _ids(node.ends[at:at + IDS])}


def _batches(rows: Iterable[dict], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def _rows(batches) -> Iterator[dict]:
    return (row for batch in batches for row in batch.to_pylist())


def _by_shard(open_ends: Broadcast):
    def finish(batches):
        # Several shards may meet in one task, each in order.
        yield from _batches(row for _, rows in itertools.groupby(_rows(batches), key=lambda row: row["shard"])
                            for row in _handed_in(_shard_nodes(rows, open_ends.value)))
    return finish


def _finish_skeleton(batches):
    """Skeleton nodes come from the deepest up, their parts added up."""
    rows = list(_rows(batches))
    by_name = {row["node"]: row for row in rows}
    for row in rows:
        row["n_leaves"] += not row["n_children"]
        row["saved_tokens"] += (row["n_convs"] - 1) * row["chars"]
        if row["parent"] is not None:
            above = by_name[row["parent"]]
            row["parent_conv_id"] = above["conv_id"]
            above["n_children"] += 1
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
    yield from _batches(rows)


def _hash_ids(batches):
    """Digest of the ids of each node, whose parts come in order: one pass, no part is held."""
    def rows():
        for node, parts in itertools.groupby(_rows(batches), key=lambda row: row["node"]):
            digest = hashlib.sha256(next(parts)["ids"])
            for part in parts:
                digest.update(b"," + part["ids"])
            yield {"node": node, "ends_sha256": digest.hexdigest()}
    yield from _batches(rows())


def splitters(pieces: DataFrame, n: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Rows with their shard, and how many turns its first path shares with the path before it, its
    last with the path behind it.

    Two paths a shard come to the driver, one after another, each of at most PIECE digests.
    """
    dealt = materialize(pieces.repartitionByRange(n, "path", "conv_id").withColumn(
        "shard", F.spark_partition_id()), "trie-shards")
    open_ends, before = {}, None
    for row in dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).orderBy(
            "shard").toLocalIterator():
        shared = _shared(bytes(before["last"]), bytes(row["first"])) if before else 0
        if before:
            open_ends[before["shard"]] = (open_ends[before["shard"]][0], shared)
        open_ends[row["shard"]], before = (shared, 0), row
    return dealt, open_ends


_RESULT = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "via"]


def _one_level(pieces: DataFrame) -> DataFrame:
    """All nodes of the tries of one level."""
    spark = pieces.sparkSession
    digests = pieces.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-digests // SHARD_DIGESTS))
    dealt, open_ends = splitters(pieces, n)
    # Two numbers a shard.
    shared = spark.sparkContext.broadcast(open_ends)
    parts = materialize(dealt.repartition(n, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(
        _by_shard(shared), _NODES), "trie-parts")
    added = parts.where("node IS NOT NULL AND ids IS NULL").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("parent", "depth", "chars")], F.min("conv_id").alias("conv_id"),
        F.max("via").alias("via"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    gaps = {c: F.lit(None).cast(kind) for c, kind in (x.split() for x in _NODES.split(", ")) if c not in added.columns}
    # As small as the splitters, so one task.
    skeleton = materialize(added.withColumns(gaps).select(_SCHEMA.names).repartition(1).sortWithinPartitions(
        F.desc("depth")).mapInArrow(_finish_skeleton, _NODES), "trie-skeleton").drop("ends_sha256")
    # Read back from files, so its size is known: a small one is broadcast to the many children of a node.
    above = skeleton.select(F.col("node").alias("above"), F.col("conv_id").alias("above_conv"))
    ends = parts.where("ids IS NOT NULL").repartition("node").sortWithinPartitions("node", "first").mapInArrow(
        _hash_ids, _NODES).select("node", F.col("ends_sha256").alias("digest"))
    skeleton = skeleton.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(_NO_IDS)))
    local = parts.where("node IS NULL").join(above, F.col("parent") == F.col("above"), "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above_conv"))
    return materialize(local.select(_RESULT).unionByName(skeleton.select(_RESULT)), "trie-nodes")


def trie(turns: DataFrame, conv_ids: DataFrame, piece: int = PIECE) -> DataFrame:
    """Nodes of the trie of conversations given as turns (conv_id, place, digest, chars).

    conv_ids has all conversations, turnless ones too.
    """
    pieces = materialize(paths(turns, conv_ids, piece), "trie-paths")
    below, found = None, []
    for level in range(pieces.agg(F.max("level")).first()[0] or 0, -1, -1):
        rows = pieces.where(F.col("level") == level)
        if below is None:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("up_children", "up_leaves", "up_saved")})
        else:
            tops = below.where("depth = 1").select(
                "conv_id", F.col("n_children").alias("up_children"), F.col("n_leaves").alias("up_leaves"),
                F.col("saved_tokens").alias("up_saved"))
            rows = rows.join(tops, "conv_id", "left")
        nodes = _one_level(rows)
        if below is not None:
            # A piece's first nodes hang below the node at which the piece above them ends.
            end = nodes.where("via IS NOT NULL").select(F.col("via").alias("of"), F.col("conv_id").alias("real"))
            deeper = below.where("depth > 1").join(
                end, (F.col("depth") == 2) & (F.col("parent_conv_id") == F.col("of")), "left")
            found.append(deeper.withColumn("parent_conv_id", F.coalesce("real", "parent_conv_id")).withColumn(
                "depth", F.col("depth") - 1 + (level + 1) * piece).select(_RESULT))
        below = nodes
    for more in found:
        below = below.unionByName(more)
    return below.select(_RESULT[:-1])


BASE, SHARED = 100, 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin like the first of their hundred, and all conv_ids."""
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    ids = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"),
                        F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), SHARED).alias("own_from"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    ids = materialize(ids.join(bases, "base", "left").select(
        "conv_id", "base", "own_from", F.least("own_from", F.coalesce("n_base", F.lit(0))).alias("shared")), "trie-ids")
    # At most SHARED - 1 turns of a base, for at most BASE conversations.
    first = turns.where(F.col("place") < SHARED - 1).withColumnRenamed("conv_id", "base")
    start = ids.where("shared > 0").join(first, "base").where("place < shared").select(
        "conv_id", "place", "digest", "chars")
    rest = turns.join(ids, "conv_id").where("place >= own_from").select(
        "conv_id", (F.col("place") - F.col("own_from") + F.col("shared")).alias("place"), "digest", "chars")
    return start.unionByName(rest), ids.select("conv_id")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie(*rebuilt(materialize(numbered(rows), "numbered")))


ORACLE_SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           coalesce(text, '')) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  -- CRC-32 of the decimal id, bit by bit: a byte comes in, then eight shifts.
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
      list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda acc, s: CASE WHEN s >= 0 THEN xor(acc, s) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END
    ), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), sized AS (
  SELECT ids.*, least(h, (SELECT count(*) FROM own WHERE own.conv_id = ids.base)) AS shared FROM ids
), turns AS (
  SELECT s.conv_id, o.place, role, text FROM sized s JOIN own o ON o.conv_id = s.base AND o.place < s.shared
  UNION ALL
  SELECT s.conv_id, o.place - s.h + s.shared, role, text FROM sized s JOIN own o ON o.conv_id = s.conv_id AND o.place >= s.h
), members AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS node, NULL AS parent, 0 AS chars FROM ids
  UNION ALL
  SELECT conv_id, place + 1, string_agg(md5(length(role) || ':' || role || text), '') OVER w,
    substr(string_agg(md5(length(role) || ':' || role || text), '') OVER w, 1, (32 * place)::INT), length(text)
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), lengths AS (
  SELECT conv_id, max(depth) AS length FROM members GROUP BY conv_id
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars,
    min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM members JOIN lengths USING (conv_id) GROUP BY node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  -- A node's smallest member passes through all nodes above it.
  SELECT m.node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n LEFT JOIN children c ON c.node = n.node
    JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes p ON p.node = n.parent
"""

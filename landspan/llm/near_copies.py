"""Near copies by their words: all pairs of texts with a five-word similarity of 0.8 or more.

A text is the set of hashes of its runs of ``SHINGLE`` lower-case (A-Z) words. Two texts are near
copies when their sets share ``SHARE`` of their union. The search loses no such pair: hashes are put in one
order, those that many sets of a sample hold last, and two such sets of n hashes agree in one of
their first n - ceil(SHARE * n) + 1 (prefix). Where prefixes meet, sizes are looked at (length) and whether
enough follows if this is the first hash they share (position), then parities of the hashes by ``FOLDS`` x 64 places, which differ in no
more places than the sets in hashes, then the sets themselves.

Two sets that have the same hash just before a hash share that one, too, so they have met before and form no pair
here; a bucket in which all do is left out. Where more than ``FEW`` sets meet, each is first compared with one of
them only, the hub: the set in which the
hash has the fewest rarer ones before it, so the one with the least text of its own. Copies of one original that
differ from each other by their own changes all come near it. So an entry of a prefix makes two rows at most,
however large its bucket. Hashes that a good part of the sample holds meet in
``SALTS`` parts, each with a hub of its own, so no task gets all texts that hold a common line; rows of one hash
pass through a task without being gathered. Buckets that are not in one component then form the pairs of different
components, up to ``BUCKET`` sets. Sets of larger ones, crowds, meet once more, in
an order that holds the hashes of these crowds last, by their number of members: a sample doesn't know hashes that
few texts in a thousand hold, but in a large table these few are many. What still makes crowds is compared with hubs
of whole crowds in ``ROUNDS`` rounds, each outside the components of the ones before; afterwards the pairs that
are not in one component yet are compared.

Prefixes, and the compressed text of each distinct set, are written with the rows. Sets are
compared in cells, which get each text once: candidate pairs that hang together share a cell, a large
cluster is dealt to the cells of pairs of blocks. Texts that no pair wants are told by a table of bits before
they are shuffled, and so are rows that stay for certain in the end.

Fingerprints that operator 8 links stay linked: they are the nodes of the components. Null texts
count as empty; texts of fewer words are one run; texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.llm import simhash
from landspan.llm.components import components
from landspan.llm.tables import BATCH_ROWS
from landspan.workspace import materialize, settled

SHINGLE = 5
# Part of the union, in tenths.
SHARE = 8
# Sets that meet in all pairs: at first, and where they are not in one component.
FEW, BUCKET = 4, 32
# Texts of the sample that tells common hashes, and in how many of them a common one stands.
SAMPLE, COMMON = 20_000, 20
FOLDS = 8
# Parts of a hash that more than this share of the sample holds, and rows of one hash held at once.
SALTS, HOT_SHARE, HELD = 64, 0.01, 20_000
# Sets that are compared in one cell, about.
CELL = 1024
# Hubs of a whole crowd, and hashes that the second order knows.
ROUNDS, KNOWN = 2, 200_000
# Bits a key in a table of bits, and the most bits of one (8 MB). A full table lets all rows pass.
SPACE, MOST_BITS = 16, 1 << 26


def shingle_set(text: str) -> np.ndarray:
    """Distinct hashes of the runs of words, ascending."""
    words = text.encode().translate(simhash._LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*(words[k:] for k in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(b" ".join(run)) for run in runs}), np.uint64)


def _mark(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes(), 1) - (1 << 63)


def _folded(held: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes at each place."""
    places = np.bincount((held % np.uint64(64 * FOLDS)).astype(np.int64), minlength=64 * FOLDS)
    return np.packbits((places & 1).astype(bool)).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tag"))


def _sieve(keys: DataFrame):
    """A condition on columns named like those of keys: true for rows that agree with one of keys, and for few others.

    Nulls are left out of a hash, so keys has none.
    """
    bits = 1 << min(max(SPACE * keys.count(), 64) - 1, MOST_BITS - 1).bit_length()
    place = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    found = keys.select(place.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("held")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["word"].to_numpy()] = found["held"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def held(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return held(place)


def _mapped(frame: DataFrame, rows_of, schema: str, types: list[pa.DataType]) -> DataFrame:
    """rows_of: from a list of the values of each column of a slice to arrays of columns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                columns = rows_of(batch.slice(begin, BATCH_ROWS), seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return frame.mapInArrow(run, schema)


_FOLDED = [f"fold{k}" for k in range(FOLDS)]


def _rows(docs: DataFrame, common, hot: int) -> DataFrame:
    """doc_id, tag (of the text), bits (operator 8's fingerprint), mark, size and folds (of the set) of each row.

    The first row of a set in a task also has its compressed text, its prefix, and the part of each
    hash of it: 0, or one of ``SALTS`` for a hash that at least `hot` texts of the sample hold.
    """
    def rows_of(part, seen):
        known, press = common.value, zstandard.ZstdCompressor(level=3).compress
        texts = part.column(1).to_pylist()
        sets = [shingle_set(x) for x in texts]
        folds = np.array([_folded(x) for x in sets]).reshape(-1, FOLDS)
        marks, packed, prefixes, salts = [_mark(x) for x in sets], [], [], []
        for mark, held, text in zip(marks, sets, texts):
            if mark in seen or len(held) == 0:
                packed.append(None)
                prefixes.append(None)
                salts.append(None)
                continue
            seen.add(mark)
            packed.append(press(text.encode()))
            for values, whole in zip(_prefix(held, mark, known, hot), (prefixes, salts)):
                whole.append(values)
        return (part.column(0), part.column(2), np.array([simhash.fingerprint(x) for x in texts], np.uint64).view(np.int64),
                marks, [len(x) for x in sets], *np.ascontiguousarray(folds.T), packed, prefixes, salts)

    names = ["doc_id", "tag", "bits", "mark", "size", *_FOLDED]
    return _mapped(
        _texts(docs), rows_of, ", ".join(f"{n} long" for n in names) + ", packed binary, prefix array<long>, salts array<int>",
        [pa.int64()] * len(names) + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())])


def _prefix(held: np.ndarray, mark: int, known: dict[int, int], hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The first hashes of a set, those that `known` gives a weight last, and the part of each."""
    values = held.view(np.int64)
    weight = np.array([known.get(v, 0) for v in values.tolist()]) if known else np.zeros(len(values), int)
    order = np.argsort(weight, kind="stable")[:len(held) - -(-SHARE * len(held) // 10) + 1]
    return values[order], np.where(weight[order] >= hot, 1 + mark % SALTS, 0)


def _reordered(rows: DataFrame, crowds: DataFrame, common: dict[int, int], hot: int) -> DataFrame:
    """mark, size, prefix, salts of the sets of crowds, and of few others, by the second order.

    common: the hashes of the sample, with about how many texts of all hold them.
    """
    most = crowds.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(KNOWN).toArrow()
    weights = dict(common)
    for token, n in zip(most["token"].to_pylist(), most["n"].to_pylist()):
        weights[token] = max(n, weights.get(token, 0))
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def rows_of(part, seen):
        known, unpack = shared.value, zstandard.ZstdDecompressor().decompress
        sets = [shingle_set(unpack(x).decode()) for x in part.column(1).to_pylist()]
        marks = part.column(0).to_pylist()
        found = [_prefix(held, mark, known, hot) for held, mark in zip(sets, marks)]
        return marks, [len(x) for x in sets], [x for x, _ in found], [x for _, x in found]

    wanted = rows.where("packed IS NOT NULL").select("mark", "packed").where(_sieve(crowds.select("mark").distinct()))
    return _mapped(wanted, rows_of, "mark long, size long, prefix array<long>, salts array<int>",
                   [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())])


def _common(docs: DataFrame, n_rows: int) -> dict[int, int]:
    """Hashes that many texts of a sample hold, with how many do."""
    def rows_of(part, seen):
        sets = [shingle_set(x) for x in part.column(1).to_pylist()]
        return (np.concatenate(sets).view(np.int64),)

    part = max(1, n_rows // SAMPLE)
    sample = _texts(docs).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(part)) == 0)
    found = _mapped(sample, rows_of, "token long", [pa.int64()]).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).collect()
    return {r["token"]: r["n"] for r in found}


_MET = "u long, v long, token long, salt int, size int, place int, before long"


def _meet(bucket_size: int, with_hubs: bool = True):
    """Pairs (u, v) that meet under a token; of buckets beyond bucket_size, crowds, also each member (u, no v).

    Rows (token, salt, mark, size, place, before, and root if it is known) come by token, salt, place and mark.
    Tokens dealt to parts are crowds. Of a crowd only the first member, its hub, is held, and only pairs with it
    are formed, or none. Sets of one root form no pair, and without a hub neither do sets that the token before has
    brought together.
    """
    def met(columns: list[np.ndarray], forced: bool = False) -> pa.RecordBatch:
        """forced: the first group is part of a crowd, whatever its size here."""
        token, salt, mark = columns[:3]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        keep = new.copy()
        keep[1:] |= mark[1:] != mark[:-1]
        new, (token, salt, mark, size, place, before, *more) = new[keep], [c[keep] for c in columns]
        root = more[0] if more else mark

        def needless(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return root[a] == root[b], (place[a] > 0) & (place[b] > 0) & (before[a] == before[b])

        first = np.flatnonzero(new)
        bucket = np.cumsum(new) - 1
        # Parts of a crowd may differ from each other, so only whole buckets are left out.
        whole = salt[first] == 0
        many = (np.diff(np.append(first, len(token))) > bucket_size) | ~whole
        if forced:
            whole[0], many[0] = False, True
        alike = [np.logical_and.reduceat(x, first) for x in needless(np.arange(len(token)), first[bucket])]
        crowd = many[bucket]
        members = np.flatnonzero((many & ~(whole & (alike[0] | alike[1])))[bucket])
        # The hub before may be another one, so pairs with a hub stay, whatever comes before.
        starred = np.flatnonzero(crowd) if with_hubs else members[:0]
        lefts, rights = [first[bucket[starred]]], [starred]
        for k in range(1, bucket_size):
            left = np.flatnonzero((bucket[:-k] == bucket[k:]) & ~crowd[k:]) if k < len(token) else members[:0]
            if len(left) == 0:
                break
            lefts.append(left)
            rights.append(left + k)
        a, b = np.concatenate(lefts), np.concatenate(rights)
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        # Where near copies meet first, all they share is still to come. Later meetings may be missed.
        shared = np.minimum(size[a] - place[a], size[b] - place[b])
        good = (10 * low >= SHARE * high) & ((10 + SHARE) * shared >= SHARE * (size[a] + size[b]))
        joined, met_before = needless(a, b)
        good &= ~joined & (crowd[a] | ~met_before)
        a, b = a[good], b[good]
        none = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([mark[a], mark[members]])),
            pa.concat_arrays([pa.array(mark[b]), pa.nulls(len(members), pa.int64())]),
            *(pa.array(np.concatenate([none, c[members]]), kind) for c, kind in (
                (token, pa.int64()), (salt, pa.int32()), (size, pa.int32()), (place, pa.int32()), (before, pa.int64())))],
            names=["u", "v", "token", "salt", "size", "place", "before"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        hub = None  # the first row of the crowd that goes on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [c.to_numpy().astype(np.int64) for c in batch.columns]
            last = [c[-1] for c in columns[:2]]
            start = int(np.argmax((columns[0] == last[0]) & (columns[1] == last[1])))
            # The last group may go on in the next batch.
            if start or (held and [c[-1] for c in held[-1][:2]] != [c[0] for c in columns[:2]]):
                done = [c for c in (hub, *held, [c[:start] for c in columns]) if c is not None]
                yield met([np.concatenate(c) for c in zip(*done, strict=True)], hub is not None)
                held, hub = [], None
            held.append([c[start:] for c in columns])
            if sum(len(c[0]) for c in held) > HELD:
                done = [c for c in (hub, *held) if c is not None]
                yield met([np.concatenate(c) for c in zip(*done, strict=True)], True)
                held, hub = [], [c[:1] for c in done[0]]
        if held or hub:
            done = [c for c in (hub, *held) if c is not None]
            yield met([np.concatenate(c) for c in zip(*done, strict=True)], hub is not None)

    return run


def _compare(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """The pairs of a cell whose sets are near copies."""
    unpack = zstandard.ZstdDecompressor().decompress
    sets = {mark: shingle_set(unpack(packed).decode())
            for mark, packed in zip(texts["mark"].to_pylist(), texts["packed"].to_pylist())}
    found = []
    for u, v in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist()):
        shared = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
        found.append(10 * shared >= SHARE * (len(sets[u]) + len(sets[v]) - shared))
    return pairs.select(["u", "v"]).filter(pa.array(found, pa.bool_()))


def _alike(rows: DataFrame, marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs u, v of marks whose sets are near copies."""
    def of(end: str) -> DataFrame:
        return marks.select(F.col("mark").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ["size", *_FOLDED]))

    differ = sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in _FOLDED), F.lit(0))
    pairs = materialize(
        pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        .join(of("u"), "u").join(of("v"), "v")
        .where((10 + SHARE) * differ <= (10 - SHARE) * (F.col("u_size") + F.col("v_size")))
        .select("u", "v"), "near-pairs")
    roots = materialize(components(pairs), "near-clusters")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    cells = -(-roots.count() // CELL) or 1
    blocks = F.ceil(F.col("n") / CELL)
    a, b = (F.pmod(F.xxhash64(end), blocks) for end in ("u", "v"))
    # Small clusters share cells; those of a large one are named by their blocks.
    cell = F.when(F.col("n") <= CELL, F.pmod(F.xxhash64("root"), F.lit(cells))).otherwise(
        F.xxhash64("root", F.least(a, b), F.greatest(a, b)))
    dealt = materialize(pairs.join(roots.withColumnRenamed("node", "u"), "u").join(sizes, "root").select(
        cell.alias("cell"), "u", "v"), "near-cells")
    wanted = dealt.select(F.col("u").alias("mark"), F.col("cell").alias("of")).union(dealt.select("v", "cell")).distinct()
    marks = wanted.select("mark").distinct()
    texts = rows.where("packed IS NOT NULL").select("mark", "packed").where(_sieve(marks)).join(
        marks, "mark", "left_semi").dropDuplicates(["mark"])
    return dealt.groupBy("cell").cogroup(wanted.join(texts, "mark").groupBy("of")).applyInArrow(
        _compare, "u long, v long")


def _rooted(frame: DataFrame, roots: DataFrame) -> DataFrame:
    """With the component of each node."""
    return frame.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _widened(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only those that the links touch are contracted."""
    ends = links
    for end in ("u", "v"):
        ends = ends.join(roots.toDF(end, "r"), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    more = components(ends)
    return materialize(
        roots.join(more.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        .unionByName(more.join(roots, "node", "left_anti")), "near-joined")


def _open_crowds(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their components, of crowds that are not in one component."""
    placed = _rooted(crowds, roots)
    split = placed.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s")
    return materialize(placed.join(split.select("token"), "token", "left_semi"), "near-open")


def _fit(a: str, b: str) -> Column:
    """Whether members of different components can be near copies if they meet first here."""
    return F.expr(f"""{a}.root != {b}.root
        AND 10 * least({a}.size, {b}.size) >= {SHARE} * greatest({a}.size, {b}.size)
        AND {10 + SHARE} * least({a}.size - {a}.place, {b}.size - {b}.place) >= {SHARE} * ({a}.size + {b}.size)
        AND NOT ({a}.place > 0 AND {b}.place > 0 AND {a}.before = {b}.before)""")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, tag, bits, root (a fingerprint of the component) per document row, written.

    What was written on the way is deleted, so the next stage has the disk for itself.
    """
    return settled(docs.sparkSession, lambda: _near_copies(docs), "near-roots")


def _entries(sets: DataFrame) -> DataFrame:
    """A row for each hash of a prefix of sets (mark, size, prefix, salts, and root if it is known)."""
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("prefix", F.lit(1), F.size("prefix") - 1)).alias("before")
    rest = [c for c in sets.columns if c not in ("prefix", "salts")]
    return sets.select(*rest, F.posexplode(F.arrays_zip("prefix", "salts", before)).alias("place", "at")).select(
        F.col("at.prefix").alias("token"), F.col("at.salts").alias("salt"), "mark", F.col("size").cast("int").alias("size"),
        "place", "at.before", *(c for c in rest if c == "root"))


def _met(entries: DataFrame, label: str, bucket_size: int, with_hubs: bool = True) -> DataFrame:
    """Meetings of entries, written."""
    return materialize(entries.repartition("token", "salt").sortWithinPartitions(
        "token", "salt", "place", "mark").mapInArrow(_meet(bucket_size, with_hubs), _MET), label)


def _near_copies(docs: DataFrame) -> DataFrame:
    n_rows = docs.count()
    known, hot = _common(docs, n_rows), max(COMMON, int(HOT_SHARE * min(n_rows, SAMPLE)))
    rows = materialize(_rows(docs, docs.sparkSession.sparkContext.broadcast(known), hot), "near-rows")
    marks = materialize(rows.groupBy("mark").agg(
        F.min("bits").alias("node"), *(F.min(c).alias(c) for c in ["size", *_FOLDED])), "near-marks")
    named = marks.select("mark", "node")
    same = rows.join(named, "mark").where("bits != node").select(F.col("bits").alias("u"), F.col("node").alias("v"))
    met = _met(_entries(rows.where("prefix IS NOT NULL")), "near-met", min(FEW, BUCKET))

    def links(pairs: DataFrame) -> DataFrame:
        return _alike(rows, marks, pairs).join(named.toDF("u", "a"), "u").join(named.toDF("v", "b"), "v").select(
            F.col("a").alias("u"), F.col("b").alias("v"))

    edges = materialize(
        simhash.close_pairs(rows.select("bits").distinct()).unionByName(same).unionByName(
            links(met.where("v is not null"))).distinct(), "near-edges")

    def crowded(met: DataFrame) -> DataFrame:
        return materialize(met.where("v is null").select(
            "token", "salt", F.col("u").alias("mark"), "size", "place", "before").join(named, "mark"), "near-crowds")

    roots = components(edges)
    crowds = _open_crowds(crowded(met), roots)
    if not crowds.isEmpty():
        met = _met(crowds.select("token", "salt", "mark", "size", "place", "before", "root"), "near-met", BUCKET, False)
        pairs = met.where("v is not null").select("u", "v")
        crowds = crowded(met)
        if not crowds.isEmpty():
            scale = max(1, n_rows // SAMPLE)
            again = _reordered(rows, crowds, {k: n * scale for k, n in known.items()}, hot * scale)
            met = _met(_entries(again.join(_rooted(named, roots).select("mark", "root"), "mark")), "near-met", BUCKET)
            pairs = pairs.unionByName(met.where("v is not null").select("u", "v"))
            crowds = crowded(met)
        roots = _widened(roots, links(pairs))
    hubs = crowds.select("token", "node").limit(0)
    for step in range(ROUNDS + 1):
        open_ = _open_crowds(crowds, roots)
        if open_.isEmpty():
            break
        if step == ROUNDS:
            pairs = open_.alias("a").join(open_.alias("b"), F.expr("a.token = b.token AND a.mark < b.mark") & _fit("a", "b"))
        else:
            spent = _rooted(hubs, roots).select("token", "root").distinct()
            hub = materialize(open_.join(spent, ["token", "root"], "left_anti").groupBy("token").agg(
                F.min(F.struct("place", "mark", "size", "before", "node", "root")).alias("b")).select("token", "b.*"), "near-hubs")
            hubs = hubs.unionByName(hub.select("token", "node"))
            pairs = open_.alias("a").join(hub.alias("b"), F.expr("a.token = b.token") & _fit("a", "b"))
        roots = _widened(roots, links(pairs.selectExpr("a.mark AS u", "b.mark AS v")))
    return rows.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select(
        "doc_id", "tag", "bits", F.coalesce("root", "bits").alias("root"))


def keep_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component the row of the least doc_id, with all its columns. found: of `near_copies`.

    A row is named by its id and its text; of rows that share both one is kept, so each component keeps
    one row, also if other components hold its id or all its ids are null. Rows that are kept and
    have no copy stay where they are; only others, and few of these, are shuffled.
    """
    keys = ["_id", "_none", "_tag"]
    key = {"_id": F.coalesce("doc_id", F.lit(0).cast("long")), "_none": F.isnull("doc_id")}
    row = F.struct("doc_id", "bits", "tag")
    kept = found.groupBy("root").agg(F.coalesce(
        F.min(F.when(F.col("doc_id").isNotNull(), row)), F.min(row)).alias("kept")).select("kept.*").withColumns(
        key).select("_id", "_none", F.col("tag").alias("_tag"), F.lit(True).alias("_kept"))
    doubtful = materialize(found.withColumns(key).withColumnRenamed("tag", "_tag").groupBy(keys).agg(
        F.count(F.lit(1)).alias("n")).join(kept, keys, "left").where("_kept IS NULL OR n > 1").select(keys), "near-doubtful")
    named = docs.withColumns({**key, "_tag": F.xxhash64(F.coalesce("text", F.lit("")))}).withColumn(
        "_doubt", _sieve(doubtful))
    return named.where("NOT _doubt").select(*docs.columns).unionByName(
        named.where("_doubt").join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without near copies: of each component the row of the least doc_id."""
    return keep_rows(docs, near_copies(docs))

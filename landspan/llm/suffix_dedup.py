"""Repeated byte strings by prefix-free parsing (operator 1).

A byte goes when a string of ``width`` bytes that covers it also starts anywhere else.

1. *Phrases.* A rolling hash of 16-byte grams picks triggers: for each window of ``width``
   bytes the gram with the least hash among the first ``ZONE`` ones, the last of equal ones.
   The choice depends on the bytes of the window only, so equal windows have equal triggers,
   and the windows of one trigger are one run. Such a run is a phrase: the bytes before the
   trigger (the dictionary part), and those after it (the parse).
2. *Dictionary.* Phrases meet by the hash of their core, the bytes that all their windows
   share. A phrase whose core occurs once holds nothing that repeats. Phrases with equal
   contexts repeat as a whole. Each task sends one row for a context, however many copies
   it has read, so a passage that a third of all documents share is a few rows a task.
3. *Suffix arrays.* Phrases with an equal core but unequal contexts, at the edges of copied
   passages, are put into corpus order: the parts before the trigger sorted backwards (the
   suffix array of the dictionary), the parts after it sorted forwards (the suffix array of
   the parse), each with the lengths of common prefixes. A window is repeated if it is equal
   to another in both orders.

A core that very many contexts share, such as a line of boilerplate between other words, meets
in no single task. Tasks that read two or more of its contexts report them; a core with more than
``HOT_ROWS`` reported contexts and ``HOT_SHARE`` of all phrases is dealt by context, and there are
no more than 1 / ``HOT_SHARE`` of them to broadcast. Its windows, and those of a core with more
than ``MAX_GROUP`` contexts, are counted by 128-bit hashes in an aggregation.

Null and empty texts are empty; texts shorter than ``width`` keep all. Repeated rows are
copies of each other. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.llm.hashing import Roller
from landspan.llm.tables import BATCH_ROWS, row_key
from landspan.workspace import materialize, settled

WIDTH = 200
ZONE = 128
GRAM = 16
# Rows of one core that one task sorts; beyond, its windows are counted by hash.
MAX_GROUP = 50_000
# A core is dealt by context if more rows are reported of it, and a larger share of all phrases.
HOT_ROWS, HOT_SHARE = 1000, 1e-6
# Rows sorted together.
CHUNK = 4096

_ROLLERS: dict[int, Roller] = {}


def _roller(seed: int) -> Roller:
    return _ROLLERS.setdefault(seed, Roller(seed))


def phrases(data: np.ndarray, width: int = WIDTH, zone: int = ZONE):
    """Triggers of a text: position, first and last window, hash of core and of context."""
    n = len(data)
    windows = n - width + 1
    if windows <= 0:
        return None
    roller = _roller(1)
    sums = roller.sums(data)
    grams = roller.grams(sums, GRAM)[:windows + zone - 1]
    # The upper half of the hash, then how far from the end: of equal ones the last is least.
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | (
        np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    blocks = np.full(-(-len(order) // zone) * zone, 2**64 - 1, np.uint64)
    blocks[:len(order)] = order
    blocks = blocks.reshape(-1, zone)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:windows], upto[zone - 1:zone - 1 + windows])
    at = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:], [windows]]) - 1
    at = at[first]
    core = roller.spans(sums, at, at + (width - zone + 1))
    context = roller.spans(sums, first, last + width)
    return at, first, last, core, context


_PARSED = pa.schema([
    ("core", pa.int64()), ("context", pa.int64()), ("key_id", pa.int64()), ("key_tag", pa.int64()),
    ("trigger", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("copies", pa.int32()),
    ("near", pa.int32()),
])
_PARSED_DDL = ("core long, context long, key_id long, key_tag long, trigger int, first int, last int, "
               "copies int, near int")


def _table(schema: pa.Schema, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _parse(width: int, zone: int):
    """Phrases of the documents of a task; copies within it are settled at once.

    A row with copies = 0 is a phrase known to repeat. The others go to their core: of a
    context the task has read several times, one row with copies = 2. Their ``near`` is the
    number of contexts of the core read together.
    """
    def settle(parts: list[tuple]) -> pa.RecordBatch:
        key_id, key_tag, at, first, last, core, context = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((context, core))
        new_core, new = np.ones(len(order), bool), np.ones(len(order), bool)
        new_core[1:] = core[order][1:] != core[order][:-1]
        new[1:] = new_core[1:] | (context[order][1:] != context[order][:-1])
        group, outer = np.cumsum(new) - 1, (np.cumsum(new_core) - 1)[new]
        many = np.bincount(group)[group] > 1
        sent, known = order[new], order[many]
        rows = np.concatenate([sent, known])
        none = np.zeros(len(known), np.int64)
        return _table(_PARSED, [
            core[rows].view(np.int64), context[rows].view(np.int64), key_id[rows], key_tag[rows],
            at[rows], first[rows], last[rows], np.concatenate([1 + many[new], none]),
            np.concatenate([np.bincount(outer)[outer], none])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, text in enumerate(batch.column(2)):
                found = phrases(np.frombuffer(text.as_buffer(), np.uint8), width, zone)
                if found is None:
                    continue
                size = len(found[0])
                parts.append((np.full(size, ids[k]), np.full(size, tags[k]), *found))
                held += size
                if held > 1_000_000:
                    yield settle(parts)
                    parts, held = [], 0
        if parts:
            yield settle(parts)

    return run


_MET = pa.schema([
    ("core", pa.int64()), ("key_id", pa.int64()), ("key_tag", pa.int64()), ("trigger", pa.int32()),
    ("first", pa.int32()), ("last", pa.int32()), ("copies", pa.int32()), ("group_rows", pa.int32()),
])
_MET_DDL = ("core long, key_id long, key_tag long, trigger int, first int, last int, copies int, "
            "group_rows int")


def _whole_groups(batches: Iterator[pa.RecordBatch], key: int, least: int
                  ) -> Iterator[pa.RecordBatch]:
    """Batches sorted by a column, dealt anew so that each value is in one batch."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        values = batch.column(key).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut == 0 and (len(held) == 1 or held[-2].column(key)[-1].as_py() == values[-1]):
            continue
        held[-1] = batch.slice(0, cut)
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held, rows = [batch.slice(cut)], batch.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _meet(max_group: int):
    """Phrases with one core: copies = 0 for those that repeat, others when still open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 0, 20_000):
            _, core, context, key_id, key_tag, at, first, last, copies, hot = (
                batch.column(k).to_numpy() for k in range(10))
            order = np.lexsort((context, core))
            c, x, n, h = core[order], context[order], copies[order], hot[order] > 0
            new_core, new = np.ones(len(order), bool), np.ones(len(order), bool)
            new_core[1:] = c[1:] != c[:-1]
            new[1:] = new_core[1:] | (x[1:] != x[:-1])
            group, outer = np.cumsum(new) - 1, np.cumsum(new_core) - 1
            total = np.bincount(group, n)[group]
            # The contexts of a hot core are in many tasks.
            contexts = np.where(h, max_group + 1, np.bincount(outer, new)[outer])
            repeated = total > 1
            # A core whose contexts all repeat needs no sorting.
            unsettled = h | ((np.bincount(outer, new & ~repeated)[outer] > 0) & (contexts > 1))
            opened = unsettled & new
            rows = np.concatenate([order[repeated], order[opened]])
            none = np.zeros(int(repeated.sum()), np.int64)
            yield _table(_MET, [
                core[rows], key_id[rows], key_tag[rows], at[rows], first[rows], last[rows],
                np.concatenate([none, np.minimum(total[opened], 2).astype(np.int64)]),
                np.concatenate([none, contexts[opened].astype(np.int64)])])

    return run


_BYTES = pa.schema([*(_MET.field(k) for k in range(8)), ("bytes", pa.binary())])
_BYTES_DDL = _MET_DDL + ", bytes binary"


def _cut_out(width: int):
    """Bytes of the open phrases of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(batch.num_rows):
                text = unpack(batch.column(2)[k].as_py())
                found = batch.column(3)[k].values
                columns = {f.name: found.field(f.name) for f in found.type}
                first, last = columns["first"].to_numpy(), columns["last"].to_numpy()
                columns["key_id"] = pa.array(np.full(len(first), batch.column(0)[k].as_py()), pa.int64())
                columns["key_tag"] = pa.array(np.full(len(first), batch.column(1)[k].as_py()), pa.int64())
                columns["bytes"] = pa.array(
                    [text[a:b + width] for a, b in zip(first, last)], pa.binary())
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in _BYTES], schema=_BYTES)

    return run


def _suffix_order(part: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of group and bytes; bytes each shares with the one before, -1 across groups."""
    words = np.ascontiguousarray(part).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    same = part[order][1:] == part[order][:-1]
    common = np.where(same.all(axis=1), part.shape[1], same.argmin(axis=1))
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], common])


def repeated_windows(texts: list[bytes], group: np.ndarray, left: np.ndarray, least: np.ndarray,
                     copies: np.ndarray, width: int, zone: int) -> np.ndarray:
    """Which windows of phrases with equal cores repeat: a row a phrase, a column an offset.

    left: bytes before the trigger, which is the largest offset; least: the smallest offset.
    """
    n = len(texts)
    room = -(-width // 8) * 8
    before, after = np.zeros((n, -(-zone // 8) * 8), np.uint8), np.zeros((n, room), np.uint8)
    for k, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        before[k, :left[k]] = data[:left[k]][::-1]
        after[k, :len(data) - left[k]] = data[left[k]:]
    order_left, common_left = _suffix_order(before, group)
    order_right, common_right = _suffix_order(after, group)
    out = np.zeros((n, zone), bool)
    class_left, class_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(least.min()), int(left.max()) + 1):
        rows = np.flatnonzero((least <= offset) & (offset <= left))
        if len(rows) == 0:
            continue
        class_left[order_left] = np.cumsum(common_left < offset)
        class_right[order_right] = np.cumsum(common_right < width - offset)
        _, where = np.unique(class_right[rows] * (n + 1) + class_left[rows], return_inverse=True)
        out[rows, offset] = np.bincount(where, copies[rows])[where] > 1
    return out


_SPANS = pa.schema([
    ("key_id", pa.int64()), ("key_tag", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
    ("hash_a", pa.int64()), ("hash_b", pa.int64()), ("copies", pa.int32()),
])
_SPANS_DDL = ("key_id long, key_tag long, first int, last int, hash_a long, hash_b long, "
              "copies int")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true values."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1] - 1


def _sort_out(width: int, zone: int, max_group: int):
    """Repeated windows of open phrases: the large cores' rows first, then whole cores together."""
    def large(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # Windows that repeat among these phrases are settled as runs, and one row with two copies goes on
        # for all of them. The others are one row each, counted by hash afterwards.
        hashes: tuple[list, list] = ([], [])
        for text in batch.column(8):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for seed, out in zip((2, 3), hashes):
                out.append(_roller(seed).grams(_roller(seed).sums(data), width).view(np.int64))
        size = np.array([len(x) for x in hashes[0]])
        a, b = map(np.concatenate, hashes)
        phrase = np.repeat(np.arange(len(size)), size)
        key_id, key_tag, first, copies = (batch.column(c).to_numpy()[phrase] for c in (1, 2, 4, 6))
        start = first + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group, copies[order])[group] > 1
        known = np.zeros(len(a), bool)
        known[order] = many
        known &= copies == 1  # phrases with more copies are settled already
        begins = known.copy()
        begins[1:] &= ~(known[:-1] & (phrase[1:] == phrase[:-1]))
        ends = known.copy()
        ends[:-1] &= ~(known[1:] & (phrase[1:] == phrase[:-1]))
        null = pa.nulls(int(begins.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(key_id[begins]), pa.array(key_tag[begins]), pa.array(start[begins], pa.int32()),
            pa.array(start[ends], pa.int32()), null, null, pa.nulls(len(null), pa.int32())], schema=_SPANS)
        sent = order[new]
        yield _table(_SPANS, [key_id[sent], key_tag[sent], start[sent], start[sent], a[sent], b[sent],
                              np.where(many[new], 2, 1)])

    def small(batch: pa.RecordBatch) -> pa.RecordBatch:
        core, key_id, key_tag, at, first, last, copies = (
            batch.column(k).to_numpy() for k in range(7))
        found = repeated_windows(batch.column(8).to_pylist(), core, at - first, at - last, copies,
                                 width, zone)
        # Those with copies are settled already; here they are only partners.
        row, low, high = _runs(found & (copies == 1)[:, None])
        null = pa.nulls(len(row), pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(key_id[row]), pa.array(key_tag[row]), pa.array(at[row] - high, pa.int32()),
            pa.array(at[row] - low, pa.int32()), null, null, pa.nulls(len(row), pa.int32())],
            schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, crowd = [], []
        for batch in batches:
            many = batch.column(7).to_numpy() > max_group
            crowd.append(batch.filter(pa.array(many)))
            if sum(c.num_rows for c in crowd) >= CHUNK:
                yield from large(pa.Table.from_batches(crowd).combine_chunks().to_batches()[0])
                crowd = []
            if not many.all():
                rest = [batch.filter(pa.array(~many))]
                break
        if any(c.num_rows for c in crowd):
            yield from large(pa.Table.from_batches(crowd).combine_chunks().to_batches()[0])
        for batch in _whole_groups(itertools.chain(rest, batches), 0, CHUNK):
            yield small(batch)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that the shuffle carries less."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(k, BATCH_ROWS)
            packed = pa.array([press(x) for x in part.column(part.num_columns - 1).to_pylist()],
                              pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], packed],
                names=part.schema.names)


def _hot_cores(parsed: DataFrame, hot_rows: int) -> DataFrame:
    """core, hot = 1: at most 1 / HOT_SHARE rows."""
    limit = max(hot_rows, HOT_SHARE * parsed.count())
    return parsed.where("near > 1").groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > limit).select("core", F.lit(1).alias("hot"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, zone: int = ZONE,
                   max_group: int = MAX_GROUP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Runs of windows that repeat: key_id, key_tag, first and last start of a window."""
    rows = docs.select(*row_key(), F.col("text").cast("binary").alias("bytes"))
    texts = rows.where(F.octet_length("bytes") >= width)
    parsed = materialize(texts.mapInArrow(_parse(width, zone), _PARSED_DDL), "phrases")
    sent = parsed.where("copies > 0").join(
        F.broadcast(_hot_cores(parsed, hot_rows)), "core", "left").select(
        F.when(F.col("hot") == 1, F.xxhash64("core", "context")).otherwise(F.col("core")).alias("spread"),
        "core", "context", "key_id", "key_tag", "trigger", "first", "last", "copies",
        F.coalesce("hot", F.lit(0)).alias("hot"))
    met = materialize(sent.repartition("spread").sortWithinPartitions("spread").mapInArrow(
        _meet(max_group), _MET_DDL), "phrases-met")
    settled = parsed.where("copies = 0").select("key_id", "key_tag", "first", "last").unionByName(
        met.where("copies = 0").select("key_id", "key_tag", "first", "last"))
    opened = met.where("copies > 0").groupBy("key_id", "key_tag").agg(F.collect_list(F.struct(
        "core", "trigger", "first", "last", "copies", "group_rows")).alias("found"))
    packed = texts.mapInArrow(_pack, "key_id long, key_tag long, bytes binary")
    large = F.col("group_rows") > max_group
    # Rows with one key are copies of each other: cut from one of them.
    spans = materialize(
        packed.join(opened, ["key_id", "key_tag"]).dropDuplicates(["key_id", "key_tag"])
        .select("key_id", "key_tag", "bytes", "found")
        .mapInArrow(_cut_out(width), _BYTES_DDL)
        .repartition(F.when(large, F.xxhash64("key_id", "key_tag", "first")).otherwise(F.col("core")))
        .sortWithinPartitions(~large, "core")
        .mapInArrow(_sort_out(width, zone, max_group), _SPANS_DDL), "phrase-spans")
    windows = spans.where("hash_a is not null")
    counted = windows.groupBy("hash_a", "hash_b").agg(F.sum("copies").alias("n")).where("n > 1")
    return settled.unionByName(
        spans.where("hash_a is null").select(settled.columns)).unionByName(
        windows.where("copies = 1").join(counted, ["hash_a", "hash_b"], "left_semi")
        .select(settled.columns))


def _kept(text: bytes, found: pa.Scalar, width: int) -> tuple[list[bytes], int]:
    """Pieces of a text outside its repeated windows, and how many runs were taken out."""
    if not found.is_valid or len(found.values) == 0:
        return [text], 0
    first = found.values.field("first").to_numpy()
    end = found.values.field("last").to_numpy() + width
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    starts = first[new]
    ends = end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]
    return [text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])], len(starts)


def _remove(width: int):
    """Texts without the repeated bytes, with the removed runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(begin, BATCH_ROWS)
                size, gone, runs, kept = [], [], [], []
                for packed, found in zip(part.column(1), part.column(2), strict=True):
                    text = unpack(packed.as_py())
                    pieces, count = _kept(text, found, width)
                    kept.append(b"".join(pieces))
                    size.append(len(text))
                    gone.append(len(text) - len(kept[-1]))
                    runs.append(count)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _spans_of_rows(docs: DataFrame, width: int, zone: int, max_group: int, hot_rows: int) -> DataFrame:
    return repeated_spans(docs, width, zone, max_group, hot_rows).groupBy("key_id", "key_tag").agg(
        F.collect_list(F.struct("first", "last")).alias("found"))


def strip_repeats(docs: DataFrame, width: int = WIDTH, zone: int = ZONE,
                  max_group: int = MAX_GROUP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Documents with shortened texts and their n_chars; all columns and rows stay.

    A character goes when one of its bytes does. Null texts stay null.
    """
    @F.arrow_udf("string")
    def shorten(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(["".join(p.decode("utf-8", "ignore") for p in _kept(t.as_py(), s, width)[0])
                         if t.is_valid else None for t, s in zip(texts, spans, strict=True)], pa.string())

    spans = settled(docs.sparkSession, lambda: _spans_of_rows(docs, width, zone, max_group, hot_rows).select(
        F.col("key_id").alias("_span_id"), F.col("key_tag").alias("_span_tag"),
        F.col("found").alias("_span_found")), "repeat-spans")
    key_id, key_tag = row_key()
    joined = docs.join(spans, (key_id == spans["_span_id"]) & (key_tag == spans["_span_tag"]), "left")
    text = shorten(F.col("text").cast("binary"), "_span_found")
    out = joined.withColumn("text", text).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def remove_repeats(docs: DataFrame, width: int = WIDTH, zone: int = ZONE,
                   max_group: int = MAX_GROUP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes left), one row a document row."""
    spans = _spans_of_rows(docs, width, zone, max_group, hot_rows)
    packed = docs.select(
        *row_key(), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes")
    ).mapInArrow(_pack, "key_id long, key_tag long, doc_id long, bytes binary")
    return packed.join(spans, ["key_id", "key_tag"], "left").select(
        "doc_id", "bytes", "found").mapInArrow(
        _remove(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that no 200-byte repeat covers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Alignment of the tokens of two tokenizers (operator 11).

Both tokenizers cut the bytes of a text. Offsets where tokens of both end cut it into groups, and
two tokens are linked if their bytes overlap. Token rows are cut into byte-range chunks, a token
lying in the chunk that holds its last byte. A chunk becomes a `Fragment`: an open prefix (tokens
up to its first common end), closed groups, and an open suffix (tokens after its last). Fragments
form a monoid: in a product, the suffix of the left and the prefix of the right close one group.
So the chunks of a very long document are aligned in different tasks and joined by a tree of
products, `FAN` neighbours at a time.

Short documents are aligned where they are tokenized. Documents are gathered in blocks of a few
megabytes, each with one dictionary of its linked id pairs. Only these dictionaries are counted
and joined over the corpus; a document holds places in the dictionary of its block, so what is
shuffled is no row for each document and pair. A very long document is a block of its own.

Null and empty texts, and texts that the tokens of one tokenizer don't spell, have no tokens.
Repeated rows are documents of their own. Null ids stay null. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landspan.workspace import materialize

# Bytes of a chunk; longer texts are aligned by several tasks.
CHUNK_BYTES = 1 << 16
# Bytes of text in a block of documents.
BLOCK_BYTES = 2 << 20
# Fragments multiplied by one task.
FAN = 16
# Texts tokenized at once.
TEXTS = 64


# How byte-level pre-tokenizers split a text (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_level(file: bytes, letters: dict[str, int]):
    """ids(text) and bytes(ids) of a byte-level BPE file.

    If ids are numbered in the order of merges, they are ranks, and the faster of two equal
    encoders can be used.
    """
    from tokenizers import Tokenizer

    described = json.loads(file)
    model, split = described["model"], described["pre_tokenizer"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    plain = (split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
             and not described["normalizer"] and not model.get("ignore_merges"))
    if plain and all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merges)):
        import tiktoken

        ranks = {bytes(letters[c] for c in entry): i for entry, i in model["vocab"].items() if i < 256 + len(merges)}
        fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return fast.encode_ordinary, fast.decode_bytes
    slow = Tokenizer.from_str(file.decode())
    slow.encode_special_tokens = True
    return lambda text: slow.encode(text, add_special_tokens=False).ids, None


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        """What the files of the two hold."""
        import sentencepiece

        letters = _byte_letters()
        self._a, self._a_text = _byte_level(byte_level, letters)
        self._b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        entries = json.loads(byte_level)["model"]["vocab"]
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            if all(c in letters for c in entry):
                self.a_bytes[number] = bytes(letters[c] for c in entry)
        self.b_bytes = [self._piece_bytes(i) for i in range(self._b.get_piece_size())]
        self._a_text = self._a_text or (lambda ids: b"".join(map(self.a_bytes.__getitem__, ids)))
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def _piece_bytes(self, number: int) -> bytes:
        if self._b.is_control(number) or self._b.is_unknown(number):
            return b""
        piece = self._b.id_to_piece(number)
        if self._b.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both, or None where the tokens of one don't spell a space and the text."""
        out = []
        for text, b in zip(texts, self._b.encode(texts, num_threads=1)):
            a = self._a(" " + text)
            data = b" " + text.encode()
            spelled = self._a_text(a) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            # A token without bytes (the unknown piece) has no place in the text.
            out.append((a, b) if spelled and self.a_size[a].all() and self.b_size[b].all() else None)
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: a byte that prints as
    Latin-1 stands for itself, the others take the letters from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


_LOADED: dict[tuple[bytes, bytes], Tokenizers] = {}


def _tokenizers(files: tuple[bytes, bytes]) -> Tokenizers:
    if files not in _LOADED:
        _LOADED[files] = Tokenizers(*files)
    return _LOADED[files]


@dataclass
class Run:
    """Neighbouring tokens: ids and byte offsets where they end, for both tokenizers."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def __add__(self, other: Run) -> Run:
        return Run(*[np.concatenate(x) for x in zip(self.columns(), other.columns())])

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end

    def split(self, after: int) -> tuple[Run, Run]:
        """Tokens that end up to an offset, and the others."""
        i, j = np.searchsorted(self.a_end, after, "right"), np.searchsorted(self.b_end, after, "right")
        return (Run(self.a[:i], self.a_end[:i], self.b[:j], self.b_end[:j]),
                Run(self.a[i:], self.a_end[i:], self.b[j:], self.b_end[j:]))


_NOTHING = Run(*[np.empty(0, np.int64)] * 4)


@dataclass
class Fragment:
    """Part of an alignment. Without a cut, `prefix` holds all tokens and nothing else is set."""

    cut: bool
    prefix: Run
    suffix: Run = field(default_factory=lambda: _NOTHING)
    n_groups: int = 0
    # Closed groups as text, each ended by ";", and links as id pairs with their number.
    groups: bytes = b""
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


def ends_and_cuts(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Where a token ends, and where tokens of both sides do."""
    ends = np.concatenate([run.a_end, run.b_end])
    ends.sort(kind="stable")  # two sorted runs are merged
    same = ends[1:] == ends[:-1]
    return ends[np.append(~same, True)] if len(ends) else ends, ends[1:][same]


def group_text(run: Run, cuts: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3;`` of a run that the cuts (its last end among them) divide."""
    a_stop, b_stop = (np.searchsorted(end, cuts, "right") for end in (run.a_end, run.b_end))
    names = _names(max(run.a.max(initial=0), run.b.max(initial=0)))
    said = np.empty((len(run.a) + len(run.b), names.shape[2]), np.uint8)
    # A token stands behind those of its side and those of the other side in the groups before.
    for ids, own, other, mark in ((run.a, a_stop, np.append(0, b_stop[:-1]), 1), (run.b, b_stop, a_stop, 2)):
        kind = np.zeros(len(ids), np.int64)
        kind[own - 1] = mark
        said[np.arange(len(ids)) + np.repeat(other, np.diff(own, prepend=0))] = names[kind, ids]
    flat = said.ravel()
    return flat[flat != 0].tobytes()


_NAMES: list[np.ndarray] = []


def _names(most: int) -> np.ndarray:
    """Bytes of the decimal ids up to at least `most`, followed by each separator; 0 stands for none."""
    if not _NAMES or _NAMES[0].shape[1] <= most:
        size = 1 << max(16, int(most).bit_length())
        digits = np.array([b"%d" % i for i in range(size)])
        said = np.zeros((3, size, digits.itemsize + 1), np.uint8)
        said[:, :, 1:] = digits.view(np.uint8).reshape(size, -1)
        # The separator is put where the digits end.
        ends = np.char.str_len(digits)
        said[:, :, :-1] = said[:, :, 1:]
        for k, mark in enumerate(b",|;"):
            said[k, :, -1] = 0
            said[k, np.arange(size), ends] = mark
        _NAMES[:] = [said]
    return _NAMES[0]


def fragment(run: Run) -> Fragment:
    """Prefix, closed groups and suffix of the tokens of one chunk."""
    _, cuts = ends_and_cuts(run)
    if not len(cuts):
        return Fragment(False, run)
    prefix, rest = run.split(cuts[0])
    closed, suffix = rest.split(cuts[-1])
    return Fragment(True, prefix, suffix, *_closed(closed, cuts[1:]))


def _closed(run: Run, cuts: np.ndarray) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    if not len(cuts):
        return 0, b"", np.empty(0, np.int64), np.empty(0, np.int64)
    # Each interval between ends is the overlap of one link.
    ends, _ = ends_and_cuts(run)
    pairs = pair_of(run.a[np.searchsorted(run.a_end, ends)], run.b[np.searchsorted(run.b_end, ends)])
    return len(cuts), group_text(run, cuts), *_counted(pairs)


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each stands."""
    pairs = np.sort(pairs)
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return pairs[first], np.diff(first, append=len(pairs))


def _added(*counted: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, place = np.unique(np.concatenate([p for p, _ in counted]), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, place, np.concatenate([t for _, t in counted]))
    return pairs, times


def times(left: Fragment, right: Fragment) -> Fragment:
    """The product of two neighbours: associative, and a fragment without tokens is neutral."""
    if not right.cut:
        if not left.cut:
            return Fragment(False, left.prefix + right.prefix)
        return Fragment(True, left.prefix, left.suffix + right.prefix, left.n_groups, left.groups,
                        left.pairs, left.times)
    if not left.cut:
        return Fragment(True, left.prefix + right.prefix, right.suffix, right.n_groups, right.groups,
                        right.pairs, right.times)
    middle = left.suffix + right.prefix
    n, text, pairs, number = _closed(middle, middle.a_end[-1:])
    pairs, number = _added((left.pairs, left.times), (pairs, number), (right.pairs, right.times))
    return Fragment(True, left.prefix, right.suffix, left.n_groups + n + right.n_groups,
                    left.groups + text + right.groups, pairs, number)


def whole(run: Run) -> Fragment:
    """The alignment of a whole text at once."""
    return Fragment(True, _NOTHING, _NOTHING, *_closed(run, ends_and_cuts(run)[1]))


def closed(whole: Fragment) -> Fragment:
    """The fragment of a whole text, whose prefix begins at its start, with nothing left open."""
    return times(Fragment(True, _NOTHING), whole)


# Rows between the stages. Arrays travel as the bytes of 64-bit numbers.

_ARRAYS = ["a", "a_end", "b", "b_end"]
_CHUNKS = "uid long, doc_id long, part long, n_a long, n_b long, " + ", ".join(f"{c} binary" for c in _ARRAYS)
_FRAGMENTS = ("uid long, doc_id long, part long, n_a long, n_b long, cut boolean, n_groups long, groups binary,"
              " pairs binary, times binary, " + ", ".join(f"{e}_{c} binary" for e in ("p", "s") for c in _ARRAYS))
# A document's `places` are steps between places in `pairs` of its block, which stands in a row
# of its own (doc_row false) with the number of documents that hold each pair.
_BLOCKS = ("block long, doc_row boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long,"
           " groups_sha256 string, width int, places binary, often int, times binary,"
           " pairs array<long>, n_docs array<int>")
_TOKENS = _BLOCKS + ", part long, " + ", ".join(f"{c} binary" for c in _ARRAYS)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
             "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


class _Block:
    """Documents whose pairs share a dictionary."""

    def __init__(self):
        self.bytes = 0
        self.documents: list[tuple[dict, np.ndarray, np.ndarray]] = []

    def add(self, row: dict, fragment: Fragment, size: int):
        self.documents.append((row | {
            "n_groups": fragment.n_groups, "n_links": int(fragment.times.sum()),
            "groups_sha256": hashlib.sha256(fragment.groups[:-1]).hexdigest()},
            fragment.pairs, fragment.times))
        self.bytes += size

    def rows(self, block: int) -> Iterator[dict]:
        """A row for each document and one for the dictionary."""
        if not self.documents:
            return
        pairs, places, n_docs = np.unique(
            np.concatenate([p for _, p, _ in self.documents]), return_inverse=True, return_counts=True)
        at = 0
        for row, own, number in self.documents:
            place = places[at:at + len(own)]
            at += len(own)
            steps, number = _narrow(np.diff(place, prepend=0)), _narrow(number)
            yield row | {"block": block, "doc_row": True, "width": steps.itemsize, "places": steps.tobytes(),
                         "often": number.itemsize, "times": number.tobytes()}
        yield {"block": block, "doc_row": False, "pairs": pairs, "n_docs": n_docs.astype(np.int32)}


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in as few bytes as the greatest needs."""
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint64)


def _wide(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"u{width}").astype(np.int64)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 128) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _run_of(ids: tuple[np.ndarray, np.ndarray], tokens: Tokenizers) -> Run:
    a, b = ids
    return Run(a, np.cumsum(tokens.a_size[a]), b, np.cumsum(tokens.b_size[b]))


def _chunks(run: Run, chunk_bytes: int) -> Iterator[dict]:
    part, rest = 0, run
    while len(rest.a) or len(rest.b):
        piece, rest = rest.split((part + 1) * chunk_bytes)
        yield {"part": part} | {c: x.tobytes() for c, x in zip(_ARRAYS, piece.columns())}
        part += 1


def _tokenize(files: Broadcast, chunk_bytes: int, block_bytes: int):
    """Short documents aligned and gathered in blocks; long ones as chunks of tokens."""
    schema = _arrow(_TOKENS)

    def rows(batches):
        tokens = _tokenizers(files.value)
        first = TaskContext.get().partitionId() << 33
        number, block = 0, _Block()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS).to_pydict()
                texts = [t or "" for t in part["text"]]
                for doc_id, text, ids in zip(part["doc_id"], texts, tokens.encode(texts)):
                    number += 1
                    if not text or ids is None:
                        yield {"block": first + number, "doc_row": True, "doc_id": doc_id, "n_a": 0, "n_b": 0,
                               "n_groups": 0, "n_links": 0, "groups_sha256": ""}
                        continue
                    run = _run_of(ids, tokens)
                    row = {"doc_id": doc_id, "n_a": len(run.a), "n_b": len(run.b)}
                    size = int(run.a_end[-1])
                    if size > chunk_bytes:
                        for chunk in _chunks(run, chunk_bytes):
                            yield row | chunk | {"block": first + number}
                        continue
                    block.add(row, whole(run), size)
                    if block.bytes >= block_bytes:
                        yield from block.rows(first + number)
                        block = _Block()
        yield from block.rows(first + number + 1)

    return lambda batches: _batches(rows(batches), schema)


def _fragment_row(row: dict, part: int, made: Fragment) -> dict:
    return {k: row[k] for k in ("uid", "doc_id", "n_a", "n_b")} | {
        "part": part, "cut": made.cut, "n_groups": made.n_groups, "groups": made.groups,
        "pairs": made.pairs.tobytes(), "times": made.times.tobytes()} | {
        f"{e}_{c}": x.tobytes() for e, run in (("p", made.prefix), ("s", made.suffix))
        for c, x in zip(_ARRAYS, run.columns())}


def _fragment_of(row: dict) -> Fragment:
    prefix, suffix = (Run(*[_numbers(row[f"{e}_{c}"]) for c in _ARRAYS]) for e in ("p", "s"))
    return Fragment(row["cut"], prefix, suffix, row["n_groups"], row["groups"],
                    _numbers(row["pairs"]), _numbers(row["times"]))


def _to_fragments(batches):
    rows = (row for batch in batches for row in batch.to_pylist())
    yield from _batches((_fragment_row(row, row["part"], fragment(Run(*[_numbers(row[c]) for c in _ARRAYS])))
                         for row in rows), _arrow(_FRAGMENTS), 8)


def _product(table: pa.Table) -> pa.Table:
    """One row of at most FAN neighbours."""
    rows = sorted(table.to_pylist(), key=lambda row: row["part"])
    made = _fragment_of(rows[0])
    for row in rows[1:]:
        made = times(made, _fragment_of(row))
    return pa.Table.from_pylist([_fragment_row(rows[0], rows[0]["part"] // FAN, made)], _arrow(_FRAGMENTS))


def _long_blocks(batches):
    def rows():
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block()
                block.add({k: row[k] for k in ("doc_id", "n_a", "n_b")}, closed(_fragment_of(row)), 0)
                yield from block.rows(row["uid"])
    yield from _batches(rows(), _arrow(_BLOCKS), 8)


def compose(chunks: DataFrame) -> DataFrame:
    """Blocks of one document each, from the chunks of long documents, by a tree of products."""
    last = chunks.agg(F.max("part")).first()[0]
    if last is None:
        return chunks.limit(0).mapInArrow(_long_blocks_of_nothing, _BLOCKS)
    fragments = chunks.repartition("uid", "part").mapInArrow(_to_fragments, _FRAGMENTS)
    while last > 0:
        fragments = fragments.withColumn("up", F.expr(f"part div {FAN}")).groupBy("uid", "up").applyInArrow(
            lambda key, table: _product(table.drop(["up"])), _FRAGMENTS)
        last //= FAN
    return fragments.mapInArrow(_long_blocks, _BLOCKS)


def _long_blocks_of_nothing(batches):
    for _ in batches:
        pass
    yield pa.RecordBatch.from_pylist([], _arrow(_BLOCKS))


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Counts of the links of a block's documents, looked up in its dictionary."""
    order = np.argsort(pairs["place"].to_numpy())
    count, best = pairs["n_docs"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    for row in docs.select(["width", "places", "often", "times"]).to_pylist():
        place = np.cumsum(_wide(row["places"], row["width"])) if row["places"] else np.empty(0, np.int64)
        number = _wide(row["times"], row["often"]) if row["times"] else np.empty(0, np.int64)
        n_best.append(int(number[best[place]].sum()))
        count_sum.append(int((number * count[place]).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column(
        "count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
           " groups_sha256 string")


def aligned_blocks(docs: DataFrame, json_path: str, model_path: str,
                   chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents and dictionaries of all blocks, written."""
    files = []
    for path in (json_path, model_path):
        with open(path, "rb") as file:
            files.append(file.read())
    # Two vocabularies, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(files))
    rows = materialize(docs.select("doc_id", "text").mapInArrow(
        _tokenize(shared, chunk_bytes, block_bytes), _TOKENS), "tokens")
    blocks = [name for name, *_ in (x.split() for x in _BLOCKS.split(", "))]
    chunks = rows.where("part IS NOT NULL").select(
        F.col("block").alias("uid"), "doc_id", "part", "n_a", "n_b", *_ARRAYS)
    long = materialize(compose(chunks), "long-alignments")
    return rows.where("part IS NULL").select(blocks).unionByName(long)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n_docs (documents that hold it linked), best (none of its A id has more)."""
    counts = blocks.where("NOT doc_row").select(
        F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.n_docs").cast("long").alias("n_docs"))
    # A window holds the pairs of one A id, at most as many as B has ids.
    top = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("n_docs") == top)


def align(docs: DataFrame, json_path: str, model_path: str,
          chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of the contract for each document row."""
    blocks = aligned_blocks(docs, json_path, model_path, chunk_bytes, block_bytes)
    own = blocks.where("NOT doc_row").select("block", F.posexplode("pairs").alias("place", "pair"))
    looked_up = own.join(pair_counts(blocks), "pair").select(
        F.col("block").alias("of"), "place", "n_docs", "best")
    with_tokens = blocks.where("doc_row AND n_a > 0").drop("doc_row", "pairs", "n_docs")
    without = blocks.where("doc_row AND n_a = 0").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"),
        F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    return with_tokens.groupBy("block").cogroup(looked_up.groupBy("of")).applyInArrow(
        _summed, _RESULT).unionByName(without)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE against pieces."""
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                 public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

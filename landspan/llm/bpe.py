"""Byte-level BPE encoding and decoding by tree reduction (operator 5).

The encoding of a text is a monoid: halves are encoded on their own, and two neighbours are
joined by encoding a window around their border again. What lies outside the window provably
stays as it was:

* *Pieces* (matches of the split pattern). The pattern decides a piece by its own characters
  and at most ``REACH`` that follow its start or end. Pieces of the left half that end that far
  before the border are final. Matching goes on from there until a piece starts where one of the
  right half starts; from such a place on, both see the same characters, so the rest is final.
* *Tokens* of one long piece. A token row is the encoding of its bytes exactly if each two
  neighbours are (merges are local). The window doubles until the pairs at both of its
  borders stand.

Decoding joins the bytes of tokens up the same tree. Null and empty texts have no tokens.
Repeated rows are encoded each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.llm.tables import BATCH_ROWS

# Characters of a text that are split at once, and bytes of a piece that are merged at once.
LEAF_CHARS, LEAF_BYTES = 8192, 6
# Characters after the start or end of a piece that the pattern may look at: "'re", or a
# space and its two neighbours.
REACH = 4
# Bytes whose best pair is found by looking at all pairs; beyond, by a heap.
SCAN_BYTES = 64
NEVER = 1 << 60
# Distinct pieces, leaves and windows whose tokens a task remembers.
MEMORY = 300_000


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str,
                 leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self._ranks = ranks
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._pattern = regex.compile(pattern)
        self._leaf_chars, self._leaf_bytes = leaf_chars, leaf_bytes
        self._memory: dict[str, tuple[int, ...]] = {}
        self._leaves: dict[bytes, tuple[int, ...]] = {}
        self._windows: dict[tuple[int, ...], tuple[int, ...]] = {}

    # Tokens of one piece.

    def _merge(self, data: bytes) -> list[int]:
        """Merges lowest rank first, of equal ranks the leftmost."""
        if len(data) > SCAN_BYTES:
            return self._merge_long(data)
        rank = self._ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [rank(data[i:i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) != NEVER:
            i = pairs.index(least)
            merged = parts[i] + parts.pop(i + 1)
            parts[i] = merged
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(merged + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + merged, NEVER)
        return [self._ranks[part] for part in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        ranks, n = self._ranks, len(data)
        end = list(range(1, n + 1))
        previous = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(rank, i, i + 2) for i in range(n - 1)
                if (rank := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= n or end[middle] != stop or not alive[middle]:
                continue
            alive[middle], end[i] = False, stop
            if stop < n:
                previous[stop] = i
                if (rank := ranks.get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (before := previous[i]) >= 0 and (rank := ranks.get(data[before:stop])) is not None:
                heapq.heappush(heap, (rank, before, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def _remember(self, memory: dict, key, value):
        if len(memory) >= MEMORY:
            memory.clear()
        memory[key] = value
        return value

    def _window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the bytes of a few tokens."""
        found = self._windows.get(tokens)
        if found is None:
            found = tuple(self._merge(self.decode(tokens)))
            if len(tokens) <= 4:
                self._remember(self._windows, tokens, found)
        return found

    def _stands(self, left: int, right: int) -> bool:
        return self._window((left, right)) == (left, right)

    def _join_tokens(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if self._stands(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            window = self._window(left[len(left) - a:] + right[:b])
            if ((a == len(left) or self._stands(left[-a - 1], window[0]))
                    and (b == len(right) or self._stands(window[-1], right[b]))):
                return left[:len(left) - a] + window + right[b:]
            width *= 2

    def _tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= self._leaf_bytes:
            return self._leaves.get(data) or self._remember(
                self._leaves, data, tuple(self._merge(data)))
        half = len(data) // 2
        return self._join_tokens(self._tree(data[:half]), self._tree(data[half:]))

    def piece(self, piece: str) -> tuple[int, ...]:
        """Tokens of one match of the pattern."""
        found = self._memory.get(piece)
        if found is None:
            data = piece.encode()
            rank = self._ranks.get(data)
            found = self._tree(data) if rank is None else (rank,)
            if len(piece) <= 64:
                self._remember(self._memory, piece, found)
        return found

    # Pieces of one text.

    def _split(self, text: str, start: int, end: int) -> list[int]:
        """Starts of the pieces of text[start:end]."""
        if end - start <= self._leaf_chars:
            return [m.start() for m in self._pattern.finditer(text, start, end)]
        middle = (start + end) // 2
        left, right = self._split(text, start, middle), self._split(text, middle, end)
        # The last pieces of the left half may change, those whose end is near the border.
        keep = len(left)
        while keep > 0 and (left[keep] if keep < len(left) else middle) + REACH > middle:
            keep -= 1
        begin = left[keep] if left else start
        del left[keep:]
        place = 0
        for match in self._pattern.finditer(text, begin, end):
            at = match.start()
            while place < len(right) and right[place] < at:
                place += 1
            if place < len(right) and right[place] == at:
                return left + right[place:]
            left.append(at)
        return left

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        if len(text) <= self._leaf_chars:
            pieces = self._pattern.findall(text)
        else:
            starts = self._split(text, 0, len(text))
            pieces = map(text.__getitem__, map(slice, starts, [*starts[1:], len(text)]))
        out: list[int] = []
        get, encode = self._memory.get, self.piece
        for piece in pieces:
            out += get(piece) or encode(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of token ids."""
        if len(ids) <= self._leaf_chars:
            return b"".join(map(self._bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (bytes of the ids) for each document row.

    The vocabulary, a file of fixed size, is read here and sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps what it has remembered from one task to the next.
        key = (vocabulary, pattern)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(shared.value, pattern))
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(begin, BATCH_ROWS)
                ids = [encoder.encode(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([encoder.decode(x) for x in ids], pa.binary())],
                    names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_texts(docs, path, public_tokenizers.PATTERN))

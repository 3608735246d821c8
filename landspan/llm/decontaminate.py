"""Benchmark decontamination by spaced seeds (operator 4).

Texts become lower-case words of letters, digits and non-ASCII characters. A seed is a fixed mask
over consecutive words; words under a 0 are ignored, so substitutions there do not hide a match.
``MASKS`` together hit every ``WINDOW`` words that differ in at most two places. Seeds of the
benchmark and of the documents that agree give an item and a shift; along that shift the words
are compared one by one, and an overlap is reported when some ``WINDOW`` consecutive words agree
in at least ``SHARE`` of the places.

The benchmark is taken in blocks of about ``BLOCK_WORDS`` words, so what a scan of the documents
holds of it has a fixed size; more items mean more scans. Items shorter than ``WINDOW`` words
count when all their words stand in a document; items under five words carry no evidence and
never match. Null texts are empty. Repeated rows are reported each, once a pair. Null ids are
reported as null. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.llm.hashing import Roller, mix

WINDOW, SHARE = 13, 0.8
MASKS = ("11010011", "1011101", "11111")
BLOCK_WORDS = 1_000_000
# Bits of the table that tells most other seeds apart before they are searched.
TABLE_BITS = 22

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _chars in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz"):
    _WORD[list(_chars)] = True
_FACTORS = np.random.default_rng(7).integers(1, 2**63, 16, np.uint64) | np.uint64(1)
_ROLLER = Roller(5)


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash for each word of a text."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    edges = np.flatnonzero(np.diff(np.pad(_WORD[data], 1).view(np.int8)))
    return _ROLLER.spans(_ROLLER.sums(data), edges[::2], edges[1::2])


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the ones of a mask, for each place of the mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += words[k:k + n] * _FACTORS[k]
    return mix(total + np.uint64(len(mask)))


class Benchmark:
    """Seeds of some benchmark items, sorted."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [item for item, _ in items]
        self.words = [word_hashes(text) for _, text in items]
        self.filter = np.zeros(1 << TABLE_BITS, bool)
        self.tables = []
        for mask in MASKS:
            found = [seeds(w, mask) for w in self.words]
            keys = np.concatenate(found) if found else np.empty(0, np.uint64)
            item = np.repeat(np.arange(len(found)), [len(x) for x in found])
            place = np.concatenate([np.arange(len(x)) for x in found]) if found else keys
            order = np.argsort(keys, kind="stable")
            self.filter[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.tables.append((keys[order], item[order], place[order]))

    def _shifts(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, document place minus item place) that share a seed."""
        out = []
        for mask, (keys, item, place) in zip(MASKS, self.tables, strict=True):
            own = seeds(words, mask)
            at = np.flatnonzero(self.filter[(own >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            low, high = np.searchsorted(keys, own[at]), np.searchsorted(keys, own[at], "right")
            count = high - low
            if not count.any():
                continue
            begin = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            hit = begin + np.arange(count.sum())
            out.append(np.stack([item[hit], np.repeat(at, count) - place[hit]]))
        return np.unique(np.concatenate(out, axis=1), axis=1).T if out else np.empty((0, 2), int)

    def overlaps(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """Item number, first word in the document, words compared, words equal: best of an item."""
        words = word_hashes(text)
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in self._shifts(words):
            own = self.words[item]
            low, high = max(0, -shift), min(len(own), len(words) - shift)
            width = min(WINDOW, len(own))
            if len(own) < 5 or high - low < width:
                continue
            equal = own[low:high] == words[low + shift:high + shift]
            sums = np.concatenate([[0], np.cumsum(equal)])
            need = math.ceil(SHARE * width) if len(own) >= WINDOW else width
            good = np.flatnonzero(sums[width:] - sums[:-width] >= need)
            if len(good) == 0:
                continue
            first, last = good[0], good[-1] + width
            found = (int(sums[last] - sums[first]), int(low + shift + first), int(last - first))
            best[item] = max(best.get(item, found), found)
        for item, (matched, first, length) in best.items():
            yield item, first, length, matched


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items of the benchmark in blocks of about so many words."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // (5 * block_words)) or 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_equal: document rows that hold benchmark passages."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for items in _blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items))
        found = texts.mapInArrow(_scan(shared), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


_FOUND = "doc_id long, item_id long, first_word long, n_words long, n_equal long"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = [(batch.column(0)[k].as_py(), known.ids[item], *rest)
                    for k in range(batch.num_rows)
                    for item, *rest in known.overlaps(batch.column(1)[k].as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)],
                names=["doc_id", "item_id", "first_word", "n_words", "n_equal"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that hold no benchmark passage, with all their columns."""
    for items in _blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items))
        docs = docs.where(_clean(shared)(F.coalesce("text", F.lit(""))))
    return docs


def _clean(shared):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        known = shared.value
        return pa.array([next(known.overlaps(x.as_py()), None) is None for x in texts], pa.bool_())

    return clean


def op4_spaced_seed_overlaps(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of the benchmark, with the item and the place."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                    spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

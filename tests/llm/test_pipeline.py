"""The pipeline stage by stage: what goes, what stays, and that columns and rows survive."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from landspan.llm import decontaminate, near_copies, simhash  # noqa: E402
from landspan.workspace import materialize


def test_stages_on_small_table(spark, sf):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        outputs[name] = docs
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before = set(ids)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good = {r.doc_id for r in outputs["quality"].collect()}
    assert sum((d in good) == bool(q) for d, q in labels.items()) >= 0.9 * len(labels)
    kept = outputs["near_dedup"]
    assert simhash.near_duplicates(kept).where("doc_id != component_id").count() == 0
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.overlaps(outputs["decontaminate"], bench).count() == 0
    lengths = {r.doc_id: r.text for r in outputs["decontaminate"].collect()}
    assert all((r.n_tokens == 0) == (not lengths[r.doc_id]) and r.n_tokens == len(r.ids)
               for r in outputs["bpe"].collect())
    assert corpus_pipeline.run(spark, sf).count() == outputs["bpe"].count()


def test_stages_on_odd_rows(spark, sf):
    pytest.importorskip("public_tokenizers")
    rows = [(None, None), (1, ""), (1, ""), (2, None), (3, "word " * 5000), (None, "x")]
    for table in (rows, []):
        docs = spark.createDataFrame(table, "doc_id long, text string").selectExpr(
            "*", "'en' AS lang", "'s' AS source", "char_length(text) AS n_chars", "1 AS score", "2 AS bits")
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), name)
        assert docs.count() <= len(table)


@pytest.mark.parametrize("bucket, common, cell, held", [(2, 3, 4, 3), (32, 20, 1024, 20_000), (2, 20, 2, 1)])
def test_near_dedup_finds_all_near_copies(spark, sf, monkeypatch, bucket, common, cell, held):
    """Texts with substituted words against all pairs of them; a line stands in half of them."""
    for name, value in (("BUCKET", bucket), ("COMMON", common), ("CELL", cell), ("HELD", held)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(1)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        words += ["one", "line", "that", "very", "many", "texts", "hold"] * (i % 2)
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    runs = {d: {tuple(t.split()[k:k + 5]) for k in range(max(1, len(t.split()) - 4))} for d, t in rows}
    plain = {d: brute.simhash(t) for d, t in rows}
    near = lambda a, b: (10 * len(runs[a] & runs[b]) >= 8 * len(runs[a] | runs[b])
                         or (plain[a] ^ plain[b]).bit_count() <= 2)
    expected = brute.groups({d: d for d in runs}, near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf)
    assert {r.doc_id for r in out.collect()} == set(expected.values())
    assert len(set(expected.values())) < simhash.keep_one(docs).count()


def test_copies_of_one_original_form_few_pairs(spark, monkeypatch):
    """40 texts, each near an original by changes of its own, but not near each other."""
    formed, alike = [], near_copies._alike

    def counted(rows, marks, pairs):
        formed.append(pairs.distinct().count())
        return alike(rows, marks, pairs)

    monkeypatch.setattr(near_copies, "_alike", counted)
    rng = random.Random(2)
    original = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(original))]
    for i in range(1, 41):
        own = list(original)
        for k in rng.sample(range(10, 190, 10), 3):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]
    assert sum(formed) <= 5 * len(rows)


def test_meetings_grow_with_the_entries_of_prefixes(spark, monkeypatch):
    """31 near copies, which meet under most hashes: at most two rows for each, not a pair for any two texts."""
    written, write = {}, near_copies.materialize

    def counted(frame, label):
        written.setdefault(label, []).append(out := write(frame, label))
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    monkeypatch.setattr(near_copies, "COMMON", 100)  # no hash is known to be common
    monkeypatch.setattr(near_copies, "settled", lambda spark, make, label: write(make(), label))
    rng = random.Random(3)
    original = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(original))]
    for i in range(1, 31):
        own = list(original)
        own[rng.randrange(10, 190)] = f"x{i}"
        rows.append((i, " ".join(own)))
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]
    entries = written["near-rows"][0].selectExpr("sum(size(prefix))").first()[0]
    assert sum(met.count() for met in written["near-met"]) <= 2 * entries

"""The training-data operators against plain versions on small tables."""

import itertools
import random
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from landspan.llm import (  # noqa: E402
    bpe,
    chat,
    components,
    decontaminate,
    fingerprints,
    licenses,
    quality,
    queries,
    sharding,
    simhash,
    suffix_dedup,
    url_filter,
)

# Extra columns whose names the operators use inside.
CLASH = ", ".join(f"'x' AS {name}" for name in (
    "shard slot size bucket key_id key_tag bits place found bytes score words tie part".split()))


def docs_of(spark, rows):
    """Documents (doc_id, text) with the other columns of the table and clashing ones."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.selectExpr("*", "'en' AS lang", "'s' AS source", "char_length(text) AS n_chars",
                            *CLASH.split(", "))


def odd_rows(seed=0, n=60):
    """Nulls, empty texts, ties, repeated rows, long and shared texts."""
    rng = random.Random(seed)
    base = "".join(rng.choice("ab") for _ in range(300))
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        text = (
            None if kind == 0 else "" if kind == 1 else "a" * rng.randrange(400) if kind == 2
            else base[rng.randrange(100):200] + "é" * rng.randrange(30) + "\n" + base[:80] if kind == 3
            else "xyz\x00" * rng.randrange(40) + base[50:130] if kind == 4
            else " ".join(rng.choice(["The", "of", "word", "é", "x\ny"]) for _ in range(300)) if kind == 5
            else "".join(rng.choice("abc d\n") for _ in range(120)) + base[120:185])
        rows.append((rng.choice([None, i, i, i]), text))
    return rows + rows[:3]


@pytest.fixture(params=["odd", "empty", "one"])
def rows(request):
    return {"odd": odd_rows(), "empty": [], "one": [(5, "one\ntext")]}[request.param]


@pytest.mark.parametrize("max_group, hot_rows", [(50_000, 1000), (3, 1000), (50_000, 1), (3, 5)])
def test_repeats(spark, rows, max_group, hot_rows):
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), 40, 20, max_group, hot_rows).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in got), key=repr)
    assert got == brute.repeats(rows, 40)


def test_rows_of_one_id_whose_short_hashes_agree(spark):
    """Two texts under one id, and two under null, with the same 32-bit Murmur hash."""
    base = "ahcmjuuhiybsyryudamlyapskpiqlusdcqrgkbg" * 2 + "ahcmjuuhiybsyryudamlya"
    grant = (" Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
             " and associated documentation files")
    for doc in (1, None):
        rows = [(doc, "--427373" + base), (doc, "-----465092" + base)]
        got = suffix_dedup.remove_repeats(docs_of(spark, rows), 40, 20).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in got),
                      key=repr) == brute.repeats(rows, 40)
    got = licenses.scan_licenses(docs_of(spark, [(1, "---42262" + grant), (1, "----239355")])).collect()
    assert sorted((r.n_words, r.labels) for r in got) == [(1, ""), (21, "mit")]


def test_strip_keeps_columns_and_whole_characters(spark):
    passage = "é" * 60
    docs = docs_of(spark, [(1, "x" + passage + "y"), (2, "zz" + passage), (3, None), (None, "")])
    out = suffix_dedup.strip_repeats(docs, 40, 20)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr) == sorted(
        [(1, "xy", 2), (2, "zz", 2), (3, None, None), (None, "", 0)], key=repr)


def test_quality_separates_held_out(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
        rows.append((i, " ".join(words) if i % 2 else " ".join(w.upper() + "!!" for w in words)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 1), (9, None)],
                                   "doc_id long, quality int")
    got = quality.score_documents(docs_of(spark, rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r.predicted == r.doc_id % 2 for r in held)
    kept = quality.keep_good(docs_of(spark, rows), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 2}


@pytest.mark.parametrize("labelled", [[], [(5, 1)], [(5, None)]])
def test_quality_without_labels(spark, rows, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    got = quality.score_documents(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


@pytest.mark.parametrize("url, host, path, rule", [
    (None, "", "", None), ("no scheme", "", "", None), ("http://A.Example.COM", "a.example.com", "", None),
    ("x://www.example.com/en/1?a#b", "www.example.com", "/en/1", "www.example.com/en/"),
    ("x://b.example.com/en/", "b.example.com", "/en/", "example.com/en/"),
    ("x://notexample.com/en/", "notexample.com", "/en/", "com/"), ("x://com/?/", "com", "/", "com/"),
    ("x://n.net/es/x://y.com/", "n.net", "/es/x://y.com/", "net/es/"), ("://?q", "", "", None),
    ("x://n.net/de/", "n.net", "/de/", None),
])
def test_url_rules(spark, url, host, path, rule):
    row = url_filter.judge_urls(spark.createDataFrame([(1, url, 2)], "page_id long, url string, host int")).first()
    assert (row.host, row.path, row.rule) == (host, path, rule)


def test_url_reputation_shrinks_to_its_parents(spark):
    bad = [(i, f"x://h{i % 5}.net/fr/{i}") for i in range(40)]
    good = [(100 + i, f"x://h{i % 5}.com/{i}") for i in range(40)]
    asked = [(900, "x://h1.net/de/"), (901, "x://new.net/de/"), (902, "x://h1.org/"), (903, None)]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(
        spark.createDataFrame(bad + good + asked, "page_id long, url string")).collect()}
    assert (got[900], got[901], got[902], got[903]) == ("block", "block", "allow", "allow")
    assert len(got) == 84
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_hosts_without_evidence_are_allowed_and_evidence_blocks(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    found = url_filter.judge_urls(pages).where("rule IS NULL").groupBy("verdict").count().collect()
    assert {r.verdict for r in found} == {"allow", "block"}
    # Neither host nor domain nor suffix has a judged page.
    bad = [(i, f"x://h{i % 9}.net/fr/{i}") for i in range(90)]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(
        [*bad, (900, "x://a.b.org/"), (901, "x://b.org/"), (902, "x://new.net/x")], "page_id long, url string")).collect()}
    assert (got[900], got[901], got[902]) == ("allow", "allow", "block")


@pytest.mark.parametrize("host, domain, suffix", [
    ("a.b.example.co.uk", "example.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("uk", "uk", "uk"), ("", "", ""),
    ("x.y.city.kobe.jp", "y.city.kobe.jp", "city.kobe.jp"), ("x.kobe.jp", "x.kobe.jp", "kobe.jp"),
    ("example.com", "example.com", "com"), ("a.example.com", "example.com", "com")])
def test_registered_names(spark, host, domain, suffix):
    columns = url_filter.registered(F.lit(host), ["co.uk", "kobe.jp", "city.kobe.jp"])
    assert tuple(spark.range(1).select(*columns).first()) == (domain, suffix)


def test_every_two_substitutions_in_a_window_are_hit():
    words = decontaminate.word_hashes(" ".join(f"w{i}" for i in range(decontaminate.WINDOW)))
    for places in itertools.combinations(range(decontaminate.WINDOW), 2):
        changed = words.copy()
        changed[list(places)] += 1
        assert any((decontaminate.seeds(words, m) == decontaminate.seeds(changed, m)).any()
                   for m in decontaminate.MASKS)


def test_overlaps(spark):
    item = [f"word{i}" for i in range(30)]
    near = list(item)
    near[4], near[12], near[20] = "x", "y", "z"
    far = [w if i % 3 else "q" for i, w in enumerate(item)]
    rows = [
        (1, "before " + " ".join(item) + " after"), (2, " ".join(near).upper()), (3, " ".join(far)),
        (4, None), (5, ""), (6, "a b c d e f g"), (7, "x " + ", ".join(item[8:22])), (7, "x " + ", ".join(item[8:22])),
        (8, " ".join(item[:12])), (None, " ".join(item)), (9, "tiny item of six words here now"),
    ]
    bench = spark.createDataFrame(
        [(10, " ".join(item)), (11, None), (12, "a b c d"), (13, "item of six words here now")],
        "item_id long, text string")
    found = decontaminate.overlaps(docs_of(spark, rows), bench)
    assert sorted(((r.doc_id, r.item_id, r.first_word, r.n_words, r.n_equal) for r in found.collect()), key=repr) == sorted([
        (1, 10, 1, 30, 30), (2, 10, 0, 30, 27), (7, 10, 0, 15, 14), (7, 10, 0, 15, 14),
        (None, 10, 0, 30, 30), (9, 13, 1, 6, 6)], key=repr)
    # The same in blocks of the benchmark, and as a filter.
    assert sorted(map(repr, decontaminate.overlaps(docs_of(spark, rows), bench, 20).collect())) == sorted(
        map(repr, found.collect()))
    kept = decontaminate.decontaminate(docs_of(spark, rows), bench, 20)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.overlaps(docs_of(spark, []), bench).count() == 0
    assert decontaminate.overlaps(docs_of(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("leaves", [(8192, 6), (7, 3)])
def test_bpe_agrees_with_library(leaves):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN, *leaves)
    rng = random.Random(2)
    parts = ["a", "b", "'s", "'ll", "'", "l", "  ", " ", "\n", "\t", "12", "é", "日", "!", "?", "##",
             "\x1c", "\x85", "\xa0", "the", "ing", "😀", "\u0301", "Z", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(500)]
    for text in [*texts, "", "a" * 700, "ab" * 400, " " * 300, "\n" * 90 + "x", "é" * 200, "=" * 301]:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_round_trip(spark, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoded = bpe.encode_texts(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, r.decoded_sha256) for r in bpe.digests(encoded).collect()), key=repr)
    assert got == sorted(((d, brute.sha(t or "")) for d, t in rows), key=repr)


def test_shards(spark, rows):
    got = sharding.assign_shards(docs_of(spark, rows), [1.0] * 16).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(
        ((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_one_more_shard_only_takes(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    now = {r.doc_id: r for r in sharding.assign_shards(docs, [1.0] * 16).collect()}
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(docs, [1.0] * 17).collect()}
    assert {d: r.grown_shard for d, r in now.items()} == grown
    moved = [d for d in grown if grown[d] != now[d].shard]
    assert all(grown[d] == 16 for d in moved) and 150 < len(moved) < 330
    heavy = [r.shard for r in sharding.assign_shards(docs, [1.0, 3.0]).collect()]
    assert 0.7 < sum(heavy) / len(heavy) < 0.8


def test_fingerprints(spark, rows):
    # Equal ids would leave the order to hashes.
    rows = [(100 - i, t) for i, (_, t) in enumerate(rows)]
    pairs = fingerprints.with_next(docs_of(spark, rows)).selectExpr("*", """concat(
        substr(text, 1, char_length(text) - char_length(text) div 3),
        substr(next_text, 1, char_length(text) div 3)) AS edited""")
    got = {r.doc_id: r for r in fingerprints.compare_versions(pairs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        row = got[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), brute.sha(edited))
        assert row.near_edited == pytest.approx(brute.line_likeness(text, edited))
        assert row.near_next == pytest.approx(brute.line_likeness(text, following))
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        assert prints.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint


def test_next_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    monkeypatch.setattr(fingerprints, "QUANTILES", 4)
    ids = [1, 2, 3, 50, 51, 52, 53, 54, 55, 60, 61, 1000, 1001, 10**12, 10**12 + 1, None]
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(frame).collect()}
    assert got == {d: f"t{order[(k + 1) % len(order)]}" for k, d in enumerate(order)}


def test_peeling_fails_then_grows(spark):
    from pyspark.sql import functions as F

    many = "\n".join(f"line {i}" for i in range(400))
    row = spark.createDataFrame([(many, "line 7\nother")], "a string, b string").select(
        fingerprints.digests(F.col("a")).alias("a"), fingerprints.digests(F.col("b")).alias("b")).select(
        "a", "b", *[fingerprints.sketch(F.col(x), F.lit(4)).alias(f"s{x}") for x in "ab"]).select(
        fingerprints.peel(fingerprints._merge(F.concat("sa", "sb")), F.lit(4)).alias("small"),
        fingerprints.difference(F.col("a"), F.col("b"), F.col("sa"), F.col("sb")).alias("grown"),
        F.array_union(F.array_except("a", "b"), F.array_except("b", "a")).alias("exact")).first()
    assert row.small is None
    assert sorted(row.grown) == sorted(row.exact) and len(row.exact) == 400


def test_simhash_components(spark, rows):
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    bits = sorted(((r.doc_id, r.bits % 2**64) for r in got), key=repr)
    assert bits == sorted(((d, brute.simhash(t)) for d, t in rows), key=repr)
    with_id = [(d, t) for d, t in rows if d is not None]
    expected = brute.groups({d: brute.simhash(t) for d, t in with_id}, lambda a, b: (a ^ b).bit_count() <= 2)
    # Null ids may link others; without them the classes are those of the plain version.
    again = simhash.near_duplicates(docs_of(spark, with_id)).collect()
    assert {(r.doc_id, r.component_id) for r in again} == set(expected.items())


@pytest.mark.parametrize("bucket", [2, 32])
def test_close_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(4)
    found = set()
    for size in [2, 3, 5, 60]:
        center = rng.getrandbits(64)
        for _ in range(size):
            value = center
            for _ in range(rng.randrange(4)):
                value ^= 1 << rng.randrange(64)
            found.add(value)
    signed = {v: v - 2**64 if v >> 63 else v for v in found}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "bits long")
    roots = {r.node: r.root for r in components.components(simhash.close_pairs(frame)).collect()}
    expected = brute.groups({v: v for v in found}, lambda a, b: (a ^ b).bit_count() <= 2)
    named = {}
    for v, root in expected.items():
        own = roots.get(signed[v], signed[v])
        assert named.setdefault(root, own) == own
    assert len(set(named.values())) == len(named)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = docs_of(spark, [(3, text), (1, text), (1, text), (2, "other words here"), (None, None),
                          (None, ""), (None, text), (None, "quite another text here")])
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 2, None, None], key=repr)


def test_keep_one_of_ids_that_components_share(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(50))
    docs = docs_of(spark, [(7, words("a")), (7, words("b")), (7, words("b")), (3, words("b")), (7, words("c")),
                           (9, words("c")), (7, None), (None, words("d")), (7, words("e"))])
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=repr) == sorted(
        [(7, words("a")), (3, words("b")), (7, words("c")), (7, None), (None, words("d")), (7, words("e"))], key=repr)


HOSTILE = ["<|im_end|>", "<\\|x", "a<", "\\", "\\n", "<\\\\|im_start|>", "\n<|im_start|>user\n", "", None, "é😀"]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole\\n"]), rng.choice(HOSTILE))
            for c in [1, 2, 3, None] for t in range(rng.choice([1, 5, 150]))]
    rows += rows[:2] + [(9, None, "assistant", "x"), (9, None, "assistant", "x")]
    log = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.render(log)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((t if t is not None else -10**9, role or "", text or "") for c, t, role, text in rows if c == conv)
        trained = "".join(text for _, role, text in own if role == "assistant")
        row = got[conv]
        assert row.n_turns == len(own)
        assert row.turns_sha256 == brute.sha("".join(f"{role}\n{text}\n" for _, role, text in own))
        assert (row.loss_chars, row.loss_sha256) == (len(trained), brute.sha(trained))
    assert chat.conversation_digests(chat.render(log.limit(0))).count() == 0


def test_chat_events(spark):
    events = [
        (1, 1, "delta", 1, "user", "Hel"), (1, 2, "delta", 1, "user", "lo"),
        (1, 3, "delta", 2, "assistant", "Wro"), (1, 4, "delta", 2, "assistant", "ng"),
        (1, 5, "regenerate", 2, "assistant", "Rig"), (1, 6, "delta", 2, "assistant", "ht"),
        (1, 7, "edit", 1, "user", "Hi"), (1, 8, "delta", 3, "user", None), (1, 9, "delta", 4, "user", "gone"),
        (1, 10, "delete", 4, "user", None),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, message_id long, role string, text string")
    got = [(r.message_id, r.role, r.text) for r in chat.reconstruct(log).orderBy("seq").collect()]
    assert got == [(1, "user", "Hi"), (2, "assistant", "Right"), (3, "user", "")]


def test_chat_events_delivered_twice(spark):
    events = [(1, 1, "delta", 1, "user", "Hel"), (1, 2, "delta", 1, "user", "lo"), (1, 3, "delta", 1, "user", "lo")]
    log = spark.createDataFrame(events + events[:2], "conv_id long, seq long, kind string, message_id long, role string,"
                                " text string")
    assert [r.text for r in chat.reconstruct(log).collect()] == ["Hellolo"]


def test_chat_query_folds_events(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*HOSTILE, None, "a", "héé"]))
            for c in [1, 2, None] for t in [None, 0, 1, 2, 2, 70]]
    rows += rows[:4]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    seen, fold = [], chat.reconstruct
    monkeypatch.setattr(chat, "reconstruct", lambda events: seen.append(events) or fold(events))
    got = {r.conv_id: r for r in chat.op9_chat_format(spark, str(tmp_path)).collect()}
    kinds = {r["kind"]: r["count"] for r in seen[0].groupBy("kind").count().collect()}
    assert set(kinds) == {"delta", "edit", "regenerate", "delete"} and kinds["delete"] == len(rows) + 2
    own = {c: sorted((t if t is not None else -1, role or "", text or "") for i, t, role, text in rows if i == c)
           for c in [1, 2, None]}
    for conv, said in own.items():
        trained = "".join(text for _, role, text in said if role == "assistant")
        assert got[conv].n_turns == len(said)
        assert got[conv].turns_sha256 == brute.sha("".join(f"{role}\n{text}\n" for _, role, text in said))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(trained), brute.sha(trained))
    assert got[-1].n_turns == 2


def test_chat_roles_come_back(spark):
    roles = ["a\0\1b", "\\n", "\\\\n", "\n\\\n", "\\\n\\n", "<\\|im_end|>", "\x00\x01n", "x\\"]
    log = spark.createDataFrame([(i, 0, role, "t") for i, role in enumerate(roles)],
                                "conv_id long, seq long, role string, text string")
    got = chat.read_back(chat.render(log)).orderBy("conv_id").select("turns.role").collect()
    assert [r.role for r in got] == [[role] for role in roles]


def test_licenses(spark, rows):
    texts = [
        "Under the MIT license under the mit-license", "x\nLicensed under the Apache License, Version 2.0.",
        "CC BY-NC 4.0 cc by nc", "This work is licensed under the GNU General Public License, version 3.",
        "this work is licensed under the GNU general license version 3", "gnu general public",
        "Permission is hereby granted free of charge to any person obtaining a copy of this software",
        "under the\nmit license", "É under the MIT License", "the the the",
    ]
    rows = rows + [(1000 + i, t) for i, t in enumerate(texts)] + [(1000, texts[0])]
    got = licenses.scan_licenses(docs_of(spark, rows)).collect()
    key = lambda r: (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
    expected = [(d, *brute.licenses(t, licenses.PHRASES, licenses.TEMPLATES, licenses.CONTAINMENT)) for d, t in rows]
    assert sorted(map(key, got), key=repr) == sorted(expected, key=repr)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_licenses_wrapped(spark):
    """Standard license texts with their own line breaks, and the same words far from each other."""
    texts = {
        "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
            of this software and associated documentation files (the "Software"), to deal
            in the Software without restriction""",
        "bsd": """// Redistribution and use in source and binary forms, with or without
            // modification, are permitted provided that the following conditions are
            // met:""",
        "gpl": """ * This program is free software: you can redistribute it and/or modify
             * it under the terms of the GNU General Public License as published by
             * the Free Software Foundation, either version 3 of the License""",
        "mpl-2": """# This Source Code Form is subject to the terms of the Mozilla Public
            # License, v. 2.0. If a copy of the MPL was not distributed with this""",
    }
    filler = " ".join(f"w{i}" for i in range(200))
    rows = [(label, f"{filler}\n{text}\n{filler}") for label, text in texts.items()]
    rows += [(label, text.replace(" ", "\n")) for label, text in texts.items()]
    rows += [("", "\n".join(f"{w} a b c" for w in text.split())) for text in texts.values()]
    got = licenses.scan_licenses(docs_of(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()
    assert {r.doc_id: r.labels for r in got} == {i: label for i, (label, _) in enumerate(rows)}


def test_license_windows():
    """Every window of a text against the windows around prefix words."""
    rng = random.Random(3)
    for _ in range(300):
        held = frozenset(range(rng.randrange(2, 7)))
        needed, width = rng.randrange(1, len(held) + 1), rng.randrange(3, 9)
        heads = frozenset(sorted(held)[:len(held) - needed + 1])
        text = [rng.choice([*range(9), None]) for _ in range(rng.randrange(30))]
        met = [(k, r) for k, r in enumerate(text) if r is not None]
        got = licenses._windows([k for k, _ in met], [r for _, r in met], held, heads, needed, width)
        every = [held.intersection(text[k:k + width]) for k in range(len(text))]
        assert max(map(len, got), default=0) == max((len(w) for w in every if len(w) >= needed), default=0)


def test_queries_on_small_table(spark, sf):
    """Queries without SQL against plain versions on the whole of the smallest table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op1_suffix_dedup"](spark, sf).collect()), key=repr)
    assert got == brute.repeats(rows, 200)
    got = {r.doc_id: r for r in queries.QUERIES["op8_simhash_components"](spark, sf).collect()}
    plain = {d: brute.simhash(t) for d, t in rows}
    classes = brute.groups(plain, lambda a, b: (a ^ b).bit_count() <= 2)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {
        d: (f"{plain[d]:016x}", classes[d]) for d in plain}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.QUERIES["op2_quality_score"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)

"""Token alignment, prefix trie and source mix against plain versions on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from landspan.llm import alignment, mixing, prefix_trie

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = [f"'x' AS {name}" for name in (
    "block part uid pair place best n_docs shard level path digest chars node depth via rank rows target finish "
    "copies tag span base shared own_from".split())]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return frame.selectExpr("*", *CLASH)


def odd_documents(seed=1, n=40):
    rng = random.Random(seed)
    words = ["the", "Alignment", "<|endoftext|>", "naïve", "数据", "\t", "x\ny", "12345", "▁", "  ", "\x00", "don't"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", " ", "a " * 400, "ééé", "a", " ".join(rng.choices(words[:8], k=200)),
                           "".join(rng.choices(words, k=9)), " ".join(rng.choices(words, k=30))])
        rows.append((rng.choice([None, i, 7]), text, rng.choice([None, "", "s1", "s2", "ß", "s1"])))
    return rows + rows[:4] + [(99, "word " * 8000 + "end", "s2")]


@pytest.fixture(params=["odd", "empty", "one"])
def rows(request):
    return {"odd": odd_documents(), "empty": [], "one": [(5, "one\ntext", None)]}[request.param]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = {v: k for k, v in alignment._byte_letters().items()}
    back = {v: k for k, v in letters.items()}

    def pieces(text):
        out = []
        for number in b.encode(text):
            piece = b.id_to_piece(number)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            out.append((number, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
        return out

    per, holding = [], collections.Counter()
    for doc_id, text, _ in rows:
        left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text).ids] if text else []
        right = pieces(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
            left = right = []
        spans = []
        for side in (left, right):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            spans.append([(i, e - len(x), e) for (i, x), e in zip(side, ends)])
        linked = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e] \
            if len(want) < 9000 else [  # a long text: only near tokens are looked at
            (i, j) for k, (i, s, e) in enumerate(spans[0])
            for j, t, f in spans[1][max(0, k - 50):k + 50] if s < f and t < e]
        groups = []
        for cut in sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]}):
            groups.append([[i for i, _, e in side if (groups[-1][2] if groups else 0) < e <= cut] for side in spans]
                          + [cut]) if len(want) < 9000 else groups.append([[], [], cut])
        per.append((doc_id, len(left), len(right), groups, linked, len(want)))
        holding.update(set(linked))
    most = collections.Counter()
    for (i, _), n in holding.items():
        most[i] = max(most[i], n)
    out = []
    for doc_id, n_a, n_b, groups, linked, size in per:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(linked), sum(holding[x] == most[x[0]] for x in linked),
                    sum(holding[x] for x in linked), ("long" if size >= 9000 else sha(text)) if n_a else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk, block", [(alignment.CHUNK_BYTES, alignment.BLOCK_BYTES), (64, 500)])
def test_alignment(spark, rows, chunk, block):
    made = alignment.align(documents(spark, rows).repartition(3), A_PATH, B_PATH, chunk, block)
    # The plain version doesn't spell the groups of the long text.
    got = sorted((tuple(r)[:-1] + ("long" if r.n_a >= 8000 else r.groups_sha256,) for r in made.collect()), key=repr)
    assert got == plain_alignment(rows)


def test_the_groups_of_a_long_text_do_not_depend_on_chunks(spark):
    rows = [(1, "données et naïveté " * 3000, None)]
    digests = {alignment.align(documents(spark, rows), A_PATH, B_PATH, chunk).first().groups_sha256
               for chunk in (100, 1000, 1 << 20)}
    assert len(digests) == 1


def test_products_of_fragments_are_associative():
    rng = np.random.default_rng(3)
    for _ in range(300):
        end = 40
        runs = []
        ends = [np.append(np.flatnonzero(rng.random(end - 1) < p) + 1, end) for p in (0.3, 0.2)]
        whole = alignment.Run(rng.integers(0, 9, len(ends[0])), ends[0], rng.integers(0, 9, len(ends[1])), ends[1])
        rest = whole
        for cut in sorted(rng.choice(end, 4, replace=False)):
            run, rest = rest.split(cut)
            runs.append(alignment.fragment(run))
        runs.append(alignment.fragment(rest))

        def tree(parts):
            if len(parts) == 1:
                return parts[0]
            k = int(rng.integers(1, len(parts)))
            return alignment.times(tree(parts[:k]), tree(parts[k:]))

        one = alignment.whole(whole)
        for other in (alignment.closed(tree(runs)), alignment.closed(alignment.fragment(whole))):
            assert one.groups == other.groups and one.n_groups == other.n_groups
            assert one.pairs.tolist() == other.pairs.tolist() and one.times.tolist() == other.times.tolist()


def test_both_byte_level_encoders_agree():
    """The slower one is taken when ids are not numbered by merges."""
    import json

    with open(A_PATH, "rb") as file:
        described = json.loads(file.read())
    described["model"]["ignore_merges"] = True  # makes the file look unlike one of ranks
    letters = alignment._byte_letters()
    with open(A_PATH, "rb") as file:
        fast, spell = alignment._byte_level(file.read(), letters)
    slow, none = alignment._byte_level(json.dumps(described).encode(), letters)
    assert spell and none is None
    for _, text, _ in odd_documents(9, 200):
        assert fast(" " + (text or "")) == slow(" " + (text or ""))


# Trie


def plain_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        out.append((len(node), min(convs), min(members[node[:-1]]) if node else None, len(convs), children[node],
                    sum(not children[m] for m in below),
                    sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m),
                    sha(",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(node)))))))
    return sorted(out, key=repr)


def odd_conversations(seed=2, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        conv = rng.choice([None, i, 100 + i, 300 + i, -i, 2**63 - 1 - i, -2**63 + i])
        first = rng.choice(["Hi", "Hello there", "é" * 30])
        for turn in range(rng.choice([1, 2, 3, 7])):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]),
                         first if not turn else rng.choice([None, "", "ok", "1:x"])))
    return rows + rows[:3] + [(7, k, "user", "long " * (k % 3)) for k in range(300)] + [
        (8, k, "user", "long " * (k % 3)) for k in range(299)]


@pytest.mark.parametrize("piece", [prefix_trie.PIECE, 5])
@pytest.mark.parametrize("kind", ["odd", "empty", "copies"])
def test_trie(spark, kind, piece):
    if kind == "empty" and piece == 5:
        pytest.skip("nothing to cut")
    rows = {"odd": odd_conversations(), "empty": [], "copies": [
        (c, t, "user", "same") for c in range(200) for t in range(9)]}[kind]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *CLASH)
    made = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(frame)), piece)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == plain_trie(rows)


def test_a_conversation_is_numbered_over_several_tasks(spark):
    rows = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "'same' AS text")
    turns = prefix_trie.numbered(rows)
    assert sorted(r.place for r in turns.collect()) == list(range(3000))


# Mix


def plain_mix(rows, weights, share, repeats):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) for _, text, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = collections.Counter()
    for (_, _, source), size in zip(rows, sizes):
        total[source] += size
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, level = set(), 0.0
    while any(total.values()) and (open_ := [s for s in names if s not in full]):
        level = (share * sum(total.values()) - sum(repeats * total[s] for s in full)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > repeats * total[s]}
        if not over:
            break
        full |= over
    target = {s: float(repeats * total[s]) if s in full else min(float(repeats * total[s]), weight[s] * level)
              for s in names}

    def turn(doc_id, text):
        key = [mixing.SEED] + ([str(doc_id)] if doc_id is not None else []) + (
            [hashlib.md5(text.encode()).hexdigest()] if text is not None else [])
        return int(hashlib.md5(":".join(key).encode()).hexdigest()[:15], 16)

    queue, upto = [], collections.Counter()
    for n in sorted(range(len(rows)), key=lambda n: (turn(*rows[n][:2]), rows[n][0] or 0)):
        source = rows[n][2]
        upto[source] += sizes[n]
        for repeat in range(repeats):
            if sizes[n]:
                queue.append(((upto[source] + repeat * total[source]) / target[source], names.index(source), upto[source],
                              repeat, n))
    taken, left = collections.Counter(), min(share, repeats) * sum(total.values())
    for *_, n in sorted(queue):
        left -= sizes[n]
        if left < 0:
            break
        taken[n] += 1
    return sorted(((doc, source, size, total[source], round(target[source], 6), taken[n])
                   for n, ((doc, _, source), size) in enumerate(zip(rows, sizes))), key=repr)


@pytest.mark.parametrize("weights, share, repeats", [([5.0, 2.0, 1.0], 1.5, 2), ([1.0], 0.4, 1), ([1.0, 3.0], 9.0, 3)])
def test_mix(spark, rows, weights, share, repeats, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 2)
    made = mixing.mix(documents(spark, rows).repartition(3), weights, share, repeats).collect()
    got = sorted(((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.times) for r in made), key=repr)
    assert got == plain_mix(rows, weights, share, repeats)


def test_sources_come_near_their_targets_however_rows_lie(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice("aaab")) for i in range(3000)]
    mixes = [mixing.mix(documents(spark, order).repartition(n), [5.0, 2.0], 1.2, 2)
             for order, n in ((rows, 2), (rows[::-1], 5))]
    one, other = (sorted(tuple(r) for r in m.collect()) for m in mixes)
    assert one == other
    for source, target, words in mixes[0].groupBy("source", "target").agg({"size": "sum"}).select(
            "source", "target", "sum(size)").collect():
        taken = sum(size * times for _, s, size, _, _, times in one if s == source)
        assert abs(taken - target) < 60

"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeats(rows, width):
    """(doc_id, bytes, removed, runs, digest of the rest) of rows (doc_id, text)."""
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    seen = collections.Counter(
        t[i:i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for doc, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - width + 1):
            if seen[text[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(text, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(text), sum(gone), runs, sha(kept)))
    return sorted(out, key=repr)


def groups(numbers, near):
    """Least key reachable from each key of a dict, where near(a, b) links two values."""
    parent = {k: k for k in numbers}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(numbers)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(numbers[a], numbers[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def line_likeness(a, b):
    x, y = collections.Counter(a.split("\n")), collections.Counter(b.split("\n"))
    differing = sum((x - y).values()) + sum((y - x).values())
    return 1 - differing / (sum(x.values()) + sum(y.values()))


def licenses(text, phrases, templates, share):
    """n_words, n_base, first, last, base labels, labels."""
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    words = words_of(text)
    places = [(i, label) for phrase, label in phrases for i in range(len(words))
              if words[i:i + len(words_of(phrase))] == words_of(phrase)]
    own = set()
    for line in (text or "").split("\n"):
        held = set(words_of(line))
        for label, template in templates:
            wanted = set(words_of(template))
            if len(held & wanted) >= share * len(wanted):
                own.add(label)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | own)))

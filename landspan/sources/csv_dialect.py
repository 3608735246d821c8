"""Which separator, quote and header a CSV has, by vote over a bounded sample."""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from dataclasses import dataclass

SEPARATORS = (",", ";", "\t", "|")
QUOTES = ('"', "'")
# Bytes of each sampled file, and files sampled.
SAMPLE_BYTES, SAMPLE_FILES = 1 << 16, 8

_BOOLEAN = re.compile(r"(?i)true|false")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_DATE = re.compile(r"\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?")


@dataclass(frozen=True)
class Dialect:
    """How records are written; `names` is set if files begin with them."""

    separator: str
    quote: str
    width: int
    names: tuple[str, ...] | None = None

    @property
    def columns(self) -> list[str]:
        """Names of the header, empty and repeated ones numbered; else column0, column1, ..."""
        out = []
        for i, name in enumerate(self.names or [""] * self.width):
            name = name.strip() or f"column{i}"
            taken = {n.lower() for n in out}
            new, k = name, 0
            while new.lower() in taken:
                k += 1
                new = f"{name}_{k}"
            out.append(new)
        return out


def records(text: str, separator: str, quote: str, whole: bool) -> list[list[str]]:
    """Records of a sample; the last one is left out if the sample may cut it."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator, quotechar=quote) if r]
    return rows if whole else rows[:-1]


def _wrapped(text: str, separator: str, quote: str) -> int:
    """Fields that stand in quotes."""
    edge = f"[{re.escape(separator)}\r\n]"
    q = re.escape(quote)
    return len(re.findall(rf"(?:(?<={edge})|\A){q}(?:[^{q}]|{q}{q})*{q}(?={edge}|\Z)", text))


def _kind(value: str) -> str:
    for name, pattern in (("boolean", _BOOLEAN), ("number", _NUMBER), ("date", _DATE)):
        if pattern.fullmatch(value.strip()):
            return name
    return "text"


def has_header(rows: list[list[str]]) -> bool:
    """Whether the first record names the columns.

    Names are distinct and no numbers or dates. If some column below holds one kind of value other
    than text, its name is text while its values are not; else all columns are text, and a name doesn't
    turn up again among the values of its column.
    """
    first, rest = rows[0], rows[1:]
    named = [cell.strip() for cell in first]
    if len(set(named) - {""}) < len([n for n in named if n]) or not any(named):
        return False
    if any(_kind(name) != "text" for name in named if name):
        return False
    if not rest:
        return True
    typed = 0
    for column in zip(*rest):
        kinds = {_kind(value) for value in column if value}
        typed += len(kinds) == 1 and kinds != {"text"}
    if typed:
        return True
    return not any(name in column for name, column in zip(named, zip(*rest)))


def candidates(samples: list[tuple[str, bool]], separator: str | None = None, quote: str | None = None,
               header: bool | None = None) -> list[Dialect]:
    """Dialects that read the samples (text, whether it is the whole file), the best first.

    A dialect's vote is the share of records with its commonest number of fields. Of equal votes
    quotes that are in use win, then more fields. Parts that are given are not voted on.
    """
    ranked = []
    for sep in (separator,) if separator else SEPARATORS:
        for q in (quote,) if quote else QUOTES:
            found = [records(text, sep, q, whole) for text, whole in samples]
            widths = Counter(len(row) for rows in found for row in rows)
            if not widths:
                continue
            width, votes = max(widths.items(), key=lambda x: (x[1], x[0]))
            if width == 1 and not separator and len(widths) > 1:
                continue
            used = sum(_wrapped(text, sep, q) for text, _ in samples)
            ranked.append(((votes / widths.total() if width > 1 else 0, used > 0, width), sep, q, found))
    # One column is what is left when no separator divides anything.
    ranked = [x for x in ranked if x[0][2] > 1] or ranked
    ranked.sort(key=lambda x: x[0], reverse=True)
    out = []
    for (_, _, width), sep, q, found in ranked:
        rows = next(([r for r in rows if len(r) == width] for rows in found if rows), [])
        if not rows:
            continue
        names = header if header is not None else has_header(rows)
        dialect = Dialect(sep, q, width, tuple(rows[0]) if names else None)
        if dialect not in out:
            out.append(dialect)
    return out

"""Boolean trigram queries from regular expressions, and an inverted trigram index over a batch of texts.

A query is True (any text may match), a trigram, or ("and" | "or", parts). It is implied by every match, so texts that
don't satisfy it can't match. Letters are folded to lower case on both sides.
"""

from __future__ import annotations

import re._constants as code
import re._parser as parser

import numpy as np

#: Strings that a part of an expression may stand for before it counts as unknown; the longest class that is spelt out.
MOST_STRINGS, MOST_CLASS = 64, 8


def _both(kind: str, parts: list) -> object:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str]) -> object:
    """What holds if one of the strings stands in a text."""
    return _both("or", [_both("and", [s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is code.LITERAL:
            out.add(chr(arg).lower())
        elif op is code.RANGE and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _parts(seq) -> list:
    """For each part either a set of the strings it stands for, or a query that its matches imply."""
    out: list = []
    for op, arg in seq:
        if op is code.LITERAL:
            out.append({chr(arg).lower()})
        elif op is code.IN:
            out.append(_class(arg) or True)
        elif op is code.SUBPATTERN:
            out += _parts(arg[3])
        elif op is code.BRANCH:
            each = [_exact(_parts(x)) for x in arg[1]]
            if all(isinstance(x, set) for x in each) and len(set().union(*each)) <= MOST_STRINGS:
                out.append(set().union(*each))
            else:
                out.append(_both("or", [_query(_parts(x)) for x in arg[1]]))
        elif op is code.AT:
            out.append({""})
        elif op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
            least, most, inner = arg
            one = _exact(_parts(inner))
            if isinstance(one, set) and (least, most) == (0, 1):
                out.append(one | {""})
            elif isinstance(one, set) and len(one) == 1:
                out += [one] * least + ([] if least == most else [True])
            elif least:
                out += [_query(_parts(inner)), True]
            else:
                out.append(True)
        else:
            out.append(True)
    return out


def _exact(parts: list) -> set[str] | object:
    """The strings that the parts stand for together, or True."""
    strings = {""}
    for p in parts:
        if not isinstance(p, set) or len(strings) * len(p) > MOST_STRINGS:
            return True
        strings = {a + b for a in strings for b in p}
    return strings


def _query(parts: list) -> object:
    found, run = [], {""}
    for p in [*parts, True]:
        if isinstance(p, set) and len(run) * len(p) <= MOST_STRINGS:
            run = {a + b for a in run for b in p}
            continue
        found.append(_of_strings(run))
        run = p if isinstance(p, set) else {""}
        if not isinstance(p, set):
            found.append(p)
    return _both("and", found)


def query_of(pattern: str) -> object:
    return _query(_parts(parser.parse(pattern)))


def trigrams_in(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


class Index:
    """Postings (numbers of texts, ascending) of the trigrams that some query names, over a batch of texts."""

    def __init__(self, wanted: set[str]):
        self.wanted = sorted(t for t in wanted if t.isascii())
        self.codes = np.array([int.from_bytes(t.encode(), "big") for t in self.wanted], dtype=np.int64)
        self.table = np.zeros(1 << 24, dtype=np.uint8 if len(self.codes) < 256 else np.uint16)
        self.table[self.codes] = np.arange(1, len(self.codes) + 1)
        self.postings: dict[str, np.ndarray] = {}
        self.rows = 0

    def fill(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        self.rows = len(raw)
        data = np.frombuffer(b"\xff\xff".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(r) + 2 for r in raw])
        self.postings = {}
        if len(data) < 3:
            return
        at = data[:-2].astype(np.int32)
        at <<= 8
        at |= data[1:-1]
        at <<= 8
        at |= data[2:]
        kind = self.table[at]
        where = np.flatnonzero(kind)
        row = np.searchsorted(ends, where, side="right")
        pairs = np.unique(kind[where].astype(np.int64) << 40 | row)
        which, row = pairs >> 40, pairs & ((1 << 40) - 1)
        edge = np.searchsorted(which, np.arange(1, len(self.wanted) + 2))
        self.postings = {t: row[edge[k] : edge[k + 1]] for k, t in enumerate(self.wanted)}

    def find(self, query: object) -> np.ndarray:
        """The texts that satisfy the query; the shortest lists are intersected first."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, str):
            return self.postings.get(query, np.arange(self.rows) if not query.isascii() else np.empty(0, dtype=np.int64))
        lists = sorted((self.find(q) for q in query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
            if query[0] == "and" and not len(out):
                break
        return out

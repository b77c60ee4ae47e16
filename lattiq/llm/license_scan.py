"""License scans: fuzzy search for short notices.

A text becomes its words with one space between. Every notice may differ by up to ``edits`` single-character edits; cut
into ``edits + 1`` pieces, at least one piece stands unchanged in each occurrence (pigeonhole). Pieces are located
exactly over slices of texts; around each hit the regex library's bounded-error matching verifies the whole notice and
gives its span and edits. Words that tell one notice from another have little or no room for edits of their own. Fixed phrases (``BASE``) are counted exactly.

No shuffle; memory is bounded by a slice of about 2 MB or the longest text. Defined results: a null text has no words;
each row of the input gives one row, repeated ones too; a very long text is read whole; of overlapping notices
the one of fewest edits, then the longest, then the first label counts; an empty table gives an empty result. Columns other than doc_id and text are not
read, whatever their names are.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, pieces, texts_of, tidy

#: Phrases and labels that the contract fixes.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Common wordings of short notices, as words; their labels, and the words that tell them from other notices.
NOTICES = {
    "licensed under the apache license": ("apache", "apache"),
    "released under the mit license": ("mit", "mit"),
    "licensed under the mit license": ("mit", "mit"),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", "granted free"),
    "redistribution and use in source and binary forms with or without modification": ("bsd", "redistribution"),
    "licensed under the gnu general public license": ("gpl", "gnu general"),
    "terms of the gnu lesser general public license": ("lgpl", "gnu lesser"),
    "licensed under the gnu affero general public license": ("agpl", "gnu affero"),
    "subject to the terms of the mozilla public license": ("mpl", "mozilla"),
    "licensed under cc by nc": ("cc-by-nc", "cc by nc"),
    "licensed under cc by sa": ("cc-by-sa", "cc by sa"),
    "licensed under cc by nd": ("cc-by-nd", "cc by nd"),
    "licensed under cc by 4 0": ("cc-by", "cc by 4 0"),
    "licensed under a creative commons attribution": ("cc-by", "attribution"),
    "licensed under a creative commons attribution noncommercial": ("cc-by-nc", "attribution noncommercial"),
    "licensed under a creative commons attribution sharealike": ("cc-by-sa", "attribution sharealike"),
    "this work is in the public domain": ("public-domain", "is in the public domain"),
    "released into the public domain": ("public-domain", "into the public domain"),
    "all rights reserved": ("reserved", "reserved"),
    "gnu general public license": ("gpl", "gnu general"),
}
#: Characters of a notice to one allowed edit.
PER_EDIT = 9
#: Letters to one allowed edit of a word that tells notices apart; words of fewer letters stand exactly.
PER_KEY_EDIT = 6
_OTHER = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes.maketrans(_OTHER + bytes(range(65, 91)), b" " * len(_OTHER) + bytes(range(97, 123)))
RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def normal(text: str) -> bytes:
    """The words of a text (runs of digits, letters, characters beyond ASCII; A-Z lowered), each between spaces."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class Notice:
    def __init__(self, words: str, label: str, key: str):
        self.label, self.edits = label, max(1, len(words) // PER_EDIT)
        self.size = len(words)
        self.expressions = [regex.compile(rb"(?b)(?:%b){e<=%d}" % (words.encode(), e)) for e in (0, self.edits)]
        part = lambda w: rb"(?:%b){e<=%d}" % (w.encode(), len(w) // PER_KEY_EDIT) if len(w) >= PER_KEY_EDIT else w.encode()
        self.key = regex.compile(b" " + b" ".join(map(part, key.split())) + b" ")
        self.letters = Counter(words.encode())
        step = self.size / (self.edits + 1)
        cuts = [round(step * k) for k in range(self.edits + 2)]
        self.seeds = [(words[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def matches(self, data: bytes, hits: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) in a text, from places where the notice may start."""
        done = -1
        for at in hits:
            if at < done:
                continue
            a, b = max(0, at - self.edits), at + self.size + 2 * self.edits
            if (self.letters - Counter(data[a:b])).total() > self.edits:  # each letter that is not there is an edit
                continue
            m = self.expressions[0].search(data, a, b) or self.expressions[1].search(data, a, b)
            if m and self.key.search(data, max(0, m.start() - 1), m.end() + 1):
                done = m.end()
                yield m.start(), m.end(), sum(m.fuzzy_counts)


@cache
def notices() -> list[Notice]:
    return [Notice(w, *x) for w, x in NOTICES.items()]


@cache
def _seeds() -> dict[bytes, list[tuple[int, int]]]:
    """Each piece, and the notices and places in them that it is cut from."""
    out: dict[bytes, list[tuple[int, int]]] = {}
    for k, n in enumerate(notices()):
        for seed, at in n.seeds:
            out.setdefault(seed, []).append((k, at))
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _heads() -> tuple[int, np.ndarray, dict[bytes, list[bytes]]]:
    """Bytes that every piece has at least (8 at most), marks of their hashes, and pieces by their first bytes."""
    size = min(8, *map(len, _seeds()))
    by: dict[bytes, list[bytes]] = {}
    for seed in _seeds():
        by.setdefault(seed[:size], []).append(seed)
    marks = np.zeros(1 << 16, dtype=bool)
    marks[[int(_hashes(h)[0]) for h in by]] = True
    return size, marks, by


def _hashes(data: bytes, size: int | None = None) -> np.ndarray:
    """A 16-bit hash of the ``size`` bytes from each place on."""
    size = size or len(data)
    codes = np.ndarray(len(data) - size + 1, dtype="<u8", buffer=data + bytes(8), strides=(1,))
    return ((codes << np.uint64(64 - 8 * size)) * _MIX) >> np.uint64(48)


def located(texts: list[bytes]) -> dict[int, dict[int, set[int]]]:
    """For texts with a hit: notice -> places where it may start."""
    size, marks, by = _heads()
    data = b"\n".join(texts)
    if len(data) < size:
        return {}
    ends = np.cumsum([len(t) + 1 for t in texts])
    out: dict[int, dict[int, set[int]]] = {}
    for at in np.flatnonzero(marks[_hashes(data, size)]).tolist():
        for seed in by.get(data[at : at + size], ()):
            if data.startswith(seed, at):
                i = int(np.searchsorted(ends, at, side="right"))
                begin = int(ends[i - 1]) if i else 0
                for k, off in _seeds()[seed]:
                    out.setdefault(i, {}).setdefault(k, set()).add(max(0, at - begin - off))
    return out


def fuzzy(data: bytes, hits: dict[int, set[int]]) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of the notices in a normal text; of overlapping ones the one of fewest edits."""
    found = [(notices()[k].label, *m) for k, at in hits.items() for m in notices()[k].matches(data, sorted(at))]
    out: list[tuple[str, int, int, int]] = []
    taken: list[tuple[int, int]] = []  # of those in out, ascending
    for x in sorted(found, key=lambda x: (x[3], x[1] - x[2], x)):
        k = bisect(taken, (x[1], x[2]))
        if (not k or taken[k - 1][1] <= x[1]) and (k == len(taken) or x[2] <= taken[k][0]):
            taken.insert(k, (x[1], x[2]))
            out.append(x)
    return out


def _base(data: bytes) -> list[tuple[int, str]]:
    """(place, label) of every place where a fixed phrase's words stand."""
    out = []
    for phrase, label in BASE.items():
        key, at = b" " + phrase.encode() + b" ", -1
        while (at := data.find(key, at + 1)) >= 0:
            out.append((at, label))
    return out


def judged(data: bytes, hits: dict[int, set[int]]) -> tuple:
    base, more = _base(data), fuzzy(data, hits)
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) if base or more else np.empty(0, int)
    word = lambda at: int(np.searchsorted(spaces, at, side="right")) - 1
    starts = [word(at) for at, _ in base]
    labels = {x for _, x in base}
    sure = max([1.0] * bool(base) + [1 - e / (b - a) for _, a, b, e in more if b > a], default=0.0)
    spans = sorted((word(a), word(b - 1) + 1, label, e) for label, a, b, e in more)
    told = lambda xs: ",".join(sorted(xs))
    return (
        max(data.count(b" ") - 1, 0), len(base), min(starts, default=None), max(starts, default=None), told(labels), told(labels | {x[0] for x in more}), sure,
        ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e in spans),
    )


def judgements(texts: list[str]) -> list[tuple]:
    data = [normal(t) for t in texts]
    hits = located(data)
    return [judged(d, hits.get(i, {})) for i, d in enumerate(data)]


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and the columns of RESULT; spans are label:first word:end word:edits."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(RESULT).fields])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]

    def work(batches):
        for batch in pieces(batches):
            rows = judgements(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True), kinds)], names=schema.names)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(work), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: one row a document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

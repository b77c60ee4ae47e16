"""Token ids of whole texts by a word-level BPE tokenizer file, with a bounded cache of encoded chunks.

Where a tokenizer splits words as ``SPLITS`` says, white space never enters a token, so a text's ids are those of its
chunks between ASCII spaces, one after the other. Most chunks come again and again; a worker keeps up to ``KEPT`` of them.
Texts go to any other tokenizer as they are, whole.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
from tokenizers import Tokenizer

from .jaccard import _mixed

KEPT = 400_000
#: The normalisation and word splits by which texts may be cut into chunks.
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _bytes(which: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(which)] = True
    return out


_SPACE, _WORD = _bytes(b" \t\n\r\v\f"), _bytes(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Marks that form a token group of their own after a letter or digit in any case.
_MARK = _bytes(b".,!?;:|%&#*$")
_CUT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Chunks:
    def __init__(self, definition: str, kept: int = KEPT):
        self.tokenizer, self.kept = Tokenizer.from_str(definition), kept
        #: Chunks' ids: those used of late, and those used before that; what comes again moves to the first.
        self.known, self.before = {}, {}
        told = json.loads(definition)
        self.cuts = all(told.get(k) == v for k, v in SPLITS.items()) and told["model"].get("end_of_word_suffix") == "</w>" and not any(told.get(k) for k in ("truncation", "padding"))
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: The narrowest kind of number that holds an id.
        self.width = "<u2" if size <= 1 << 16 else "<u4"
        self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])

    def _encode(self, missing: list[bytes]) -> None:
        """Plain words go in long rows, cut again at the ids that end words; other chunks one by one."""
        known = self.known
        plain, rest = [], []
        for c in missing:
            word = c.isalpha() or (t := c.decode()).isalpha() and max(t) < "\u0100"
            (plain if word else rest).append(c)
        rows = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        for row, e in zip(rows, self._ids([b" ".join(row).decode() for row in rows]), strict=True):
            to = (np.flatnonzero(self.ends[e]) + 1).tolist()
            if len(to) == len(row):
                raw, at = e.tobytes(), 0
                for c, end in zip(row, to, strict=True):
                    known[c] = raw[4 * at : 4 * end]
                    at = end
            else:
                rest += row
        for c, e in zip(rest, self._ids([c.decode() for c in rest]), strict=True):
            known[c] = e.tobytes()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.cuts:
            return [e.tobytes() for e in self._ids(texts)]
        if 2 * len(self.known) > self.kept:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        raw = [t.encode() for t in texts]
        # special tokens are told apart by case and marks: their texts go to the tokenizer as they are
        special = {k: ids.tobytes() for k in range(len(raw)) if b"<|" in raw[k] for ids in self._ids([texts[k]])}
        data = b" ".join([b"" if k in special else r for k, r in enumerate(raw)]).lower() + b" "
        begin, end = _chunks_of(data)
        if not len(begin):
            return [special.get(k, b"") for k in range(len(raw))]
        first, number = _distinct(data, begin, end)
        forms = [data[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        values = list(map(known.get, forms))
        missing = [k for k, v in enumerate(values) if v is None]
        for k in missing:
            v = before.get(forms[k])
            if v is not None:
                values[k] = known[forms[k]] = v
        missing = [k for k in missing if values[k] is None]
        for k in range(0, len(missing), 20_000):
            self._encode([forms[m] for m in missing[k : k + 20_000]])
        for k in missing:
            values[k] = known[forms[k]]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        count, at = size[number], (np.cumsum(size) - size)[number]
        stop = np.cumsum(count)
        out = np.frombuffer(b"".join(values), "<u4")[np.repeat(at - (stop - count), count) + np.arange(stop[-1])].tobytes()
        # chunks of each text, and so its ids
        edge = np.cumsum([0 if k in special else len(r) for k, r in enumerate(raw)]) + np.arange(len(raw))
        to = 4 * np.append(0, stop)[np.searchsorted(begin, edge)]
        return [special.get(k, out[a:b]) for k, (a, b) in enumerate(zip([0, *to[:-1].tolist()], to.tolist(), strict=True))]


def _chunks_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each chunk: between spaces, and parted where marks follow a letter or digit."""
    x = np.frombuffer(data, np.uint8)
    space = _SPACE[x]
    part = np.append(True, space[:-1])
    part[1:] |= _WORD[x[:-1]] & _MARK[x[1:]]
    part &= ~space
    begin = np.flatnonzero(part)
    stop = space.copy()  # a chunk ends at a space or at the next chunk
    stop |= part
    ends = np.flatnonzero(stop)
    return begin, ends[np.searchsorted(ends, begin) + 1]


def _distinct(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct chunk one that is it, and for every chunk the number of its distinct one.

    Chunks meet by hashes of their bytes and sizes. Then every chunk is compared with the one it met, byte by byte; chunks
    that differ from theirs count as distinct ones of their own.
    """
    eight = np.ndarray(len(data) + 24, dtype="<u8", buffer=data + bytes(32), strides=(1,))
    size = end - begin
    words = [eight[begin + 8 * k] & _CUT[np.clip(size - 8 * k, 0, 8)] for k in range(3)]
    h = _mixed((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    for w in words:
        h = _mixed((h ^ w) * np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > 24)
    for k in long.tolist():
        h[k] = hash(data[begin[k] : end[k]]) & 0xFFFFFFFFFFFFFFFF
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    mine = first[number]
    other = size != size[mine]
    for w in words:
        other |= w != w[mine]
    b, e, m = begin.tolist(), end.tolist(), mine.tolist()
    for k in long.tolist():
        other[k] |= data[b[k] : e[k]] != data[b[m[k]] : e[m[k]]]
    alone = np.flatnonzero(other)
    number[alone] = len(first) + np.arange(len(alone))
    return np.append(first, alone), number


@cache
def chunks(definition: str, kept: int = KEPT) -> Chunks:
    """The worker's cache for a tokenizer, kept from task to task. A task has one core, so the library starts no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Chunks(definition, kept)


def definition_of(path: str) -> str:
    """The tokenizer file's content, read on the driver and sent to executors with the task (1 to 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()

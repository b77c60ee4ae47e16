"""Removal of repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts in a document with
a smaller id.

Column-wise construction inserts one symbol of every string a round, so the rounds are as many as the longest string has
bytes. Documents are therefore cut into segments, in such a way that equal windows of ``LENGTH`` bytes meet: runs of
windows with one minimiser (the least hash among a window's ``GRAM``-byte parts) are segments of at most
``LENGTH + PARTS - 1`` bytes. A fragment's collection of segments has few rounds, whatever a document's length is.

1. Minimisers of all documents are dealt to fragments and counted; those of one document only can't be in a repeated
   string. The rest return to their documents. Tasks gather ``GATHER`` bytes of texts: a minimiser that several of these
   have is sent once, and its documents are answered on the spot.
2. Segments of the minimisers that are left are gathered likewise: equal ones become one form with its smallest and its
   largest document, so a line that stands in every document is sent once a gathering, not once a document. Gatherings
   are written; their forms are dealt to fragments by minimiser.
3. Forms of one minimiser are a collection; where it has one form only, no other string has its windows. All other forms of
   a fragment enter one Burrows-Wheeler transform with common prefixes, which is built
   column-wise (``transform``) by rounds over sequential files in the task's own folder. Neighbours in suffix order with
   ``LENGTH`` common bytes are equal windows; the smallest document of such a group decides.
4. What it decides on windows returns to the gatherings, which know where their forms stand, and becomes covered ranges of
   their documents; these are cut out.

Hashes and minimisers only bring candidates together: which bytes are equal is decided by the transform. Blocks of many
entries share a shuffled row. Nothing is collected on the driver. A task holds a fragment's distinct forms, at most one of
a form for each gathering.

Defined results: doc_id is a whole number; a null text has no bytes; a null doc_id counts as larger than all others, and rows that share a
doc_id don't remove each other's bytes; each row gives one row; an empty table gives an empty result; very long texts are
segments like others. Columns other than doc_id and text are not read, whatever their names are.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fragments_for, local_tmp, pieces, small, text_of, tidy
from .jaccard import FRAGMENT_BYTES, FRAGMENTS, _blocks, _mixed, _powers, _unblock, forget

LENGTH, GRAM = 50, 20
PARTS = LENGTH - GRAM + 1
SLICE = 1 << 20
#: Bytes of texts whose equal minimisers and segments are sent once.
GATHER = 4 << 20
#: Stands for further documents that have a minimiser.
MANY = -1
#: Entries of a column that are read or written at once.
BLOCK = 1 << 16
_LOW, _HIGH = np.uint16(255), np.uint16(8)
#: Stands for a missing doc_id: larger than any.
LAST = (1 << 63) - 1

_U = np.uint64


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each run of equal minimisers; no run has over length - gram + 1 windows."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    up, down, byte = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(byte[data] * up[: len(data)], out=sums[1:])
    low = sums[gram:] - sums[:-gram]
    low *= down[: len(low)]
    low ^= low >> _U(33)
    low *= _U(0xFF51AFD7ED558CCD)
    low ^= low >> _U(33)
    left, step = length - gram + 1, 1
    width = 1
    while width * 2 <= left:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if left > width:
        low = np.minimum(low[: len(low) - (left - width)], low[left - width :])
    new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    size = np.diff(np.append(new, len(low)))
    step = -(-size // left)  # longer runs, of periodic text, are cut
    first = np.repeat(new, step)
    part = np.arange(len(first)) - np.repeat(np.cumsum(step) - step, step)
    first = first + part * left
    return first, np.minimum(left, np.repeat(new + size, step) - first), low[first]


def _tokens(low: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Fragment and 32-bit number in it of minimisers."""
    h = _mixed(low)
    return (((h >> _U(32)) * _U(fragments)) >> _U(32)).astype(np.int64), h.astype(np.uint32)


def _until(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Minimum of values[: to + 1] for each ``to``."""
    if not len(to):
        return np.empty(0, values.dtype)
    stops, which = np.unique(to, return_inverse=True)
    each = np.minimum.reduceat(values[: stops[-1] + 1], np.append(0, stops[:-1] + 1))
    return np.minimum.accumulate(each)[which]


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for each pair; tables of doubling width are made one after the other."""
    out = np.empty(len(lo), dtype=values.dtype)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    order = np.argsort(level.astype(np.uint8), kind="stable")
    edge = np.searchsorted(level[order], np.arange(int(level.max(initial=-1)) + 2))
    table, width = values, 1
    for k in range(len(edge) - 1):
        ask = order[edge[k] : edge[k + 1]]
        out[ask] = np.minimum(table[lo[ask]], table[hi[ask] - width])
        if k < len(edge) - 2:
            table = np.minimum(table[:-width], table[width:])
            width *= 2
    return out


class _Column:
    """One round's transform and common prefixes: a file of two bytes an entry, written and read in order."""

    def __init__(self, path: Path):
        self.file, self.size = open(path, "w+b", buffering=0), 0

    def blocks(self, first: int = 0):
        """Arrays of entries from ``first`` on."""
        for k in range(first, self.size, BLOCK):
            self.file.seek(2 * k)
            yield np.frombuffer(self.file.read(2 * min(BLOCK, self.size - k)), np.uint16)

    def write(self, parts) -> None:
        """The next column, over the one before the last; columns only grow."""
        self.file.seek(0)
        self.size = sum(self.file.write(x.tobytes()) for x in parts) // 2

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate([*self.blocks(), np.empty(0, np.uint16)])
        return (x & _LOW).astype(np.uint8), (x >> _HIGH).astype(np.uint8)


class _Seen:
    """What a pass over a column knows of each symbol so far: occurrences, least common prefix since the last one."""

    def __init__(self):
        self.count, self.least = np.zeros(256, np.int64), np.zeros(256, np.uint8)
        #: Whether the last one was new in its round.
        self.fresh = np.zeros(256, bool)

    def block(self, x: np.ndarray, new: np.ndarray):
        """For the entries of a block that are new or right behind a new one of their symbol: place in the block, rank
        among their symbol, and the least common prefix since the entry before them of their symbol."""
        symbol, prefix = (x & _LOW).astype(np.uint8), (x >> _HIGH).astype(np.uint8)
        order = np.argsort(symbol, kind="stable")
        count = np.bincount(symbol, minlength=256)
        edge = np.cumsum(count) - count
        order, there = order[count[0] :], np.flatnonzero(count[1:]) + 1
        begin = edge[there] - count[0]
        fresh = new[order]
        ask = fresh.copy()
        ask[1:] |= fresh[:-1]
        head = np.zeros(len(order), bool)
        head[begin] = True
        ask[begin] = fresh[begin] | self.fresh[there]
        ask = np.flatnonzero(ask)
        at, first = order[ask], head[ask]
        value = np.empty(len(ask), np.uint8)
        value[~first] = _least(prefix, order[ask[~first] - 1] + 1, at[~first] + 1)
        if first.any():
            value[first] = np.minimum(self.least[symbol[at[first]]], _until(prefix, at[first]))
        rank = self.count[symbol[at]] + ask - (edge[symbol[at]] - count[0])
        tail = np.append(begin, len(order))[1:] - 1
        after = _until(np.append(prefix, np.uint8(255))[::-1], len(prefix) - 1 - order[tail])
        self.least = np.minimum(self.least, prefix.min())
        self.least[there], self.fresh[there] = after, fresh[tail]
        self.count += count
        return at, rank, value


def transform(data: np.ndarray, start: np.ndarray, length: np.ndarray, folder: Path) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of strings (bytes plus one; 0 ends each) and common prefixes of neighbours.

    Strings are told apart by their order: the suffixes that are only an end come first, in that order. Every round
    inserts one symbol of each string, from its end on; shorter strings begin later, so that all end in the last round.
    A round reads the column before in order, to rank the symbols, and again to write the next one with the new symbols
    in their places. Memory holds a block and a few numbers a string.
    """
    n, last = len(start), start + length - 1
    now, then = _Column(folder / "even"), _Column(folder / "odd")
    rounds = int(length.max(initial=0))
    begins = rounds - length  # the round in which a string begins
    ends = np.where(begins == 0, data[last], 0).astype(np.uint8)  # symbols before the ends
    now.write(ends[k : k + BLOCK].astype(np.uint16) for k in range(0, n, BLOCK))
    at = np.flatnonzero(begins == 0)  # places of the newest symbols, ascending, and their strings
    owner, total = at.copy(), np.bincount(ends, minlength=256)
    for done in range(1, rounds + 1):
        # rank
        seen, places, ranks, values, low, mine = _Seen(), [], [], [], 0, 0
        for x in now.blocks():
            to = int(np.searchsorted(at, low + len(x)))
            new = np.zeros(len(x), bool)
            new[at[mine:to] - low] = True
            mine = to
            p, r, v = seen.block(x, new)
            symbol = (x[p] & _LOW).astype(np.int64)
            places.append((new[p], np.searchsorted(at, p + low)))
            ranks.append((symbol, r))
            values.append(v)
            low += len(x)
        fresh, who = (np.concatenate(c) for c in zip(*places, strict=True))
        symbol, rank = (np.concatenate(c) for c in zip(*ranks, strict=True))
        value = np.concatenate(values)
        total[0] = 0
        to = n + (np.cumsum(total) - total)[symbol] + rank
        value = np.where(rank > 0, value + 1, 0).astype(np.uint16)
        by = np.argsort(to)
        to, value, fresh, who = to[by], value[by], fresh[by], who[by]
        at, owner = to[fresh], owner[who[fresh]]
        # symbols that come next: of the strings under way, and the last ones of those that begin
        left = length[owner] - (done - begins[owner])
        symbol = np.where(left > 0, data[np.maximum(last[owner] - (done - begins[owner]), 0)], 0).astype(np.uint16)
        begun = np.flatnonzero(begins == done)
        ends[begun] = data[last[begun]]
        then.write(_merged(now, n, ends, at, symbol, to, value))
        total += np.bincount(symbol, minlength=256) + np.bincount(ends[begun], minlength=256)
        on = left > 0
        at, owner = np.concatenate([begun, at[on]]), np.concatenate([begun, owner[on]])
        now, then = then, now
    out = now.all()
    now.file.close()
    then.file.close()
    return out


def _merged(old: _Column, n: int, ends: np.ndarray, at: np.ndarray, symbol: np.ndarray, to: np.ndarray, value: np.ndarray):
    """Blocks of the next column: the ends' symbols, then the entries before with the new ones at their places ``at``;
    common prefixes ``value`` at the places ``to``."""
    for k in range(0, n, BLOCK):
        yield ends[k : k + BLOCK].astype(np.uint16)
    low, mine, told = n, 0, 0
    held, source = np.empty(0, np.uint16), old.blocks(n)
    total = old.size + len(at)
    while low < total:
        high = min(total, low + BLOCK)
        a, b = mine, int(np.searchsorted(at, high))
        c, d = told, int(np.searchsorted(to, high))
        mine, told = b, d
        need = high - low - (b - a)
        while len(held) < need:
            held = np.concatenate([held, next(source)])
        out, keep = np.empty(high - low, np.uint16), np.ones(high - low, bool)
        keep[at[a:b] - low] = False
        out[keep], held = held[:need], held[need:]
        out[at[a:b] - low] = symbol[a:b]
        where = to[c:d] - low
        out[where] = out[where] & _LOW | value[c:d] << _HIGH
        low = high
        yield out


def smallest(data: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, folder: Path, window: int = LENGTH) -> np.ndarray:
    """For each place in the strings where a window begins: the smallest ``doc`` of the strings that hold it."""
    bwt, lcp = transform(data + 1, start, length, folder)
    order = np.argsort(bwt, kind="stable")[np.count_nonzero(bwt == 0) :]
    n = len(start)
    back = np.empty(len(bwt), dtype=np.int32)  # place of the suffix that is one symbol longer
    back[order] = n + np.arange(len(order), dtype=np.int32)
    group = np.cumsum(lcp < window, dtype=np.int32) - 1
    at, who = np.arange(n), np.arange(n)
    value = np.full(len(bwt), LAST, dtype=np.int64)
    where, place = [], []
    for done in range(1, int(length.max()) + 1):
        on = length[who] >= done
        at, who = back[at[on]], who[on]
        if done >= window:
            value[at] = doc[who]
            where.append(start[who] + length[who] - done)
            place.append(at)
    where, place = np.concatenate(where), np.concatenate(place)
    least = np.minimum.reduceat(value, np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
    out = np.full(len(data), LAST, dtype=np.int64)
    out[where] = least[group[place]]
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """The arrays' sizes and bytes."""
    return b"".join([np.array([x.nbytes for x in arrays], np.int64).tobytes(), *(x.tobytes() for x in arrays)])


def _unpack(block: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(block, np.int64, len(kinds))
    ends = np.cumsum(sizes) + 8 * len(kinds)
    return [np.frombuffer(block, k, n // np.dtype(k).itemsize, e - n) for k, n, e in zip(kinds, sizes.tolist(), ends.tolist(), strict=True)]


#: What a gathering sends to a fragment (smallest and largest document, minimiser, size and bytes of its forms), what it keeps of a
#: fragment (document's number, place, form's number), what returns (form's number, first window, windows, document), and
#: its documents (id, mark).
FORMS, PLACES, ANSWER, DOCS = (np.int64, np.int64, np.uint32, np.uint8, np.uint8), (np.uint32, np.int64, np.uint32), (np.uint32, np.uint8, np.uint8, np.int64), (np.int64, np.int64)


def _edges(values: np.ndarray) -> list[int]:
    """Where runs of equal values begin, and the end."""
    return [*np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist(), len(values)] if len(values) else []


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _joined(batch):
    """A batch's texts as bytes with a separator that UTF-8 has not, and where each begins."""
    raw = [(t or "").encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return np.frombuffer(b"\xff".join([*raw, b""]), np.uint8), begin


def _gathered(batches, work):
    """Lists of ``work``'s results for slices of ``SLICE`` bytes, about ``GATHER`` bytes to a list."""
    held, size = [], 0
    for batch in pieces(batches, limit=SLICE):
        data, begin = _joined(batch)
        held.append(work(batch, data, begin))
        size += len(data)
        if size >= GATHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _inside(first: np.ndarray, size: np.ndarray, low: np.ndarray, begin: np.ndarray):
    """Runs without the windows that cross from one text to the next: text, first window, windows, minimiser."""
    row = np.searchsorted(begin, first, side="right") - 1
    # windows that begin before the next text's separator comes into them
    left = np.minimum(first + size, begin[row + 1] - LENGTH) - first
    # a run may go on in the next text
    over = first + size > begin[row + 1]
    more_first, more_size = begin[row[over] + 1], (first + size)[over] - begin[row[over] + 1]
    row = np.concatenate([row, row[over] + 1])
    first, size, low = np.concatenate([first, more_first]), np.concatenate([left, more_size]), np.concatenate([low, low[over]])
    ok = (size > 0) & (row < len(begin) - 1)
    row, first, size, low = row[ok], first[ok], size[ok], low[ok]
    size = np.minimum(first + size, begin[row + 1] - LENGTH) - first
    ok = size > 0
    return row[ok], first[ok], size[ok], low[ok]


def covered(docs: DataFrame, fragments: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(d, h, a, b): for each document with covered bytes its id, mark of its text, and its maximal ranges a to b."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    if fragments is None:
        fragments = fragments_for(docs, FRAGMENT_BYTES, FRAGMENTS)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("h"), "text").where(F.octet_length("text") >= LENGTH)
    rows = rows.select(F.xxhash64("d", "h").alias("k"), "d", "h", "text")  # k tells rows apart

    def minimisers(batches):
        def one(batch, data, begin):
            row, _, _, low = _inside(*runs(data), begin)
            part, token = _tokens(low, fragments)
            code, key = part << 32 | token, batch.column(0).to_numpy()[row]
            by = np.lexsort((key, code))
            code, key = code[by], key[by]
            new = np.append(True, (code[1:] != code[:-1]) | (key[1:] != key[:-1]))[: len(code)]
            return code[new], key[new]

        for held in _gathered(batches, one):
            code, key = (np.concatenate(c) for c in zip(*held, strict=True))
            by = np.lexsort((key, code))
            code, key = code[by], key[by]
            first = np.append(True, code[1:] != code[:-1])[: len(code)]
            several = np.append(~first[1:], False)[: len(code)] | ~first
            # codes of several documents: these know, and the fragment gets one of them and MANY
            own = np.argsort(key[several], kind="stable")
            told, codes = key[several][own], code[several][own]
            out = [(int(told[a]) % fragments, None, int(told[a]), codes[a:b].tobytes()) for a, b in pairwise(_edges(told))]
            many = code[several & first]
            code, key = np.concatenate([code[first], many]), np.concatenate([key[first], np.full(len(many), MANY)])
            part = code >> 32
            by = np.lexsort((code, key, part))
            out += [(p, block, None, None) for p, block in _blocks(part[by], key[by], code[by].astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["part", "block", "k", "v"])
        forget()

    def count(batches):
        blocks: dict[int, list[bytes]] = {}
        answer = lambda got: pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([v for _, v in got], pa.binary())], names=["k", "v"])
        for batch in batches:
            got = []
            for part, block, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None:
                    got.append((k, v))
                else:
                    blocks.setdefault(part, []).append(block)
            yield answer(got)
        for part in list(blocks):
            key, token = (np.concatenate(x) for x in zip(*map(_unblock, blocks.pop(part)), strict=True))
            names, number = np.unique(key, return_inverse=True)
            both = np.unique(token.astype(_U) << _U(32) | number.astype(_U))
            token, number = (both >> _U(32)).astype(np.int64), (both & _U(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            df = np.diff(np.append(new, len(token)))
            more = np.repeat(df > 1, df) & (names[number] != MANY)
            token, number = token[more], number[more]
            by = np.argsort(number, kind="stable")
            token, number = token[by], number[by]
            value = (np.int64(part) << 32 | token).tobytes()
            yield answer([(int(names[number[a]]), value[8 * a : 8 * b]) for a, b in pairwise(_edges(number))])
        forget()

    def segments(batches):
        def one(batch, data, begin):
            row, first, size, low = _inside(*runs(data), begin)
            part, token = _tokens(low, fragments)
            code = (part << 32) | token
            hit = np.zeros(len(row), dtype=bool)
            by = np.argsort(row, kind="stable")
            edge = np.searchsorted(row[by], np.arange(len(begin)))
            for k, v in enumerate(batch.column(4).to_pylist()):
                mine = by[edge[k] : edge[k + 1]]
                hit[mine] = np.isin(code[mine], np.frombuffer(b"".join(v), np.int64))
            row, first, size, code = row[hit], first[hit], size[hit] + LENGTH - 1, code[hit]
            ids, marks = (batch.column(k).to_numpy() for k in (1, 2))
            return row, first - begin[row], size, code, data[_spread(first, size)].tobytes(), ids, marks

        task = TaskContext.get().partitionId()
        for number, held in enumerate(_gathered(batches, one)):
            base = np.cumsum([0, *(len(x[5]) for x in held)])
            row = np.concatenate([x[0] + b for x, b in zip(held, base.tolist(), strict=False)])
            at, size, code = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
            raw = b"".join([x[4] for x in held])
            ids, marks = (np.concatenate([x[k] for x in held]) for k in (5, 6))
            to, by = np.cumsum(size), np.argsort(code >> 32, kind="stable")
            names: dict[bytes, int] = {}
            form = np.array([names.setdefault(raw[b - s : b], len(names)) for b, s in zip(to[by].tolist(), size[by].tolist(), strict=True)], np.int64)
            row, at, part = row[by], at[by], code[by] >> 32
            token = np.empty(len(names), np.uint32)
            token[form] = code[by].astype(np.uint32)
            least, most = np.full(len(names), LAST, np.int64), np.zeros(len(names), np.int64)
            np.minimum.at(least, form, ids[row])
            np.maximum.at(most, form, ids[row])
            text, length = b"".join(names), np.array([len(x) for x in names], np.int64)
            ends, name = np.cumsum(length), task << 32 | number
            out = [(name, -1, None, _pack(ids, marks))] if len(row) else []
            for a, b in pairwise(_edges(part)):
                f, t = int(form[a]), int(form[a:b].max()) + 1
                mine = text[int(ends[f] - length[f]) : int(ends[t - 1])]
                out.append((name, int(part[a]), _pack(least[f:t], most[f:t], token[f:t], length[f:t].astype(np.uint8), np.frombuffer(mine, np.uint8)), _pack(row[a:b].astype(np.uint32), at[a:b], (form[a:b] - f).astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "part", "forms", "places"])
        forget()

    def decide(batches):
        blocks: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for name, part, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks.setdefault(part, []).append((name, block))
        for part in list(blocks):
            names, got = zip(*blocks.pop(part), strict=True)
            least, most, token, size, data = (np.concatenate(x) for x in zip(*(_unpack(b, *FORMS) for b in got), strict=True))
            of = np.cumsum([0, *(int(np.frombuffer(b, np.int64, 1)[0]) // 8 for b in got)])
            size = size.astype(np.int64)
            raw, to = data.tobytes(), np.cumsum(size)
            number: dict[bytes, int] = {}
            form = np.array([number.setdefault(raw[b - s : b], len(number)) for b, s in zip(to.tolist(), size.tolist(), strict=True)])
            owner = np.full(len(number), LAST, dtype=np.int64)
            np.minimum.at(owner, form, least)
            forms, length = np.frombuffer(b"".join(number), np.uint8), np.array([len(k) for k in number])
            start, value = np.cumsum(length) - length, np.repeat(owner, length)
            # forms that are the only one of their minimiser are collections of a single string: no other has their windows
            minimiser = np.empty(len(number), np.uint32)
            minimiser[form] = token
            _, group, members = np.unique(minimiser, return_inverse=True, return_counts=True)
            near = np.flatnonzero(members[group] > 1)
            if len(near):
                own, place = length[near], _spread(start[near], length[near])
                with local_tmp() as folder:
                    value[place] = smallest(forms[place], np.cumsum(own) - own, own, owner[near], Path(folder))
            # runs of windows with one smallest document
            windows = length - LENGTH + 1
            where = _spread(start, windows)
            value, whose = value[where], np.repeat(np.arange(len(length)), windows)
            edge = np.array(_edges(whose << np.int64(8) | np.append(0, np.cumsum(value[1:] != value[:-1])) & 255))
            new = edge[:-1]
            run_of, first = whose[new], where[new] - start[whose[new]]
            lo, hi = np.searchsorted(run_of, form), np.searchsorted(run_of, form, side="right")
            run, mine = _spread(lo, hi - lo), np.repeat(np.arange(len(form)), hi - lo)
            use = value[new][run] < most[mine]  # others remove nothing there
            run, mine = run[use], mine[use]
            cut = np.searchsorted(mine, of)
            rows = []
            for k, (a, b) in enumerate(pairwise(cut.tolist())):
                if a < b:
                    r = run[a:b]
                    rows.append((names[k], part, _pack((mine[a:b] - of[k]).astype(np.uint32), first[r].astype(np.uint8), np.diff(edge)[r].astype(np.uint8), value[new][r])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["slice", "part", "answer"])
        forget()

    def ranges(batches):
        """Rows of a gathering: its documents, then for each fragment the places of forms and, if there is one, the answer."""
        now, docs_of, places, found = None, None, None, []

        def done():
            if not found:
                return None
            row, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            by = np.lexsort((a, row))
            row, a, b = row[by].astype(np.int64), a[by], b[by]
            far = np.maximum.accumulate(row << np.int64(40) | b)
            new = np.append(True, (row << np.int64(40) | a)[1:] > far[:-1])
            begin = np.flatnonzero(new)
            a, b, row = a[begin], far[np.append(begin[1:], len(far)) - 1] & ((1 << 40) - 1), row[begin]
            edge = np.array(_edges(row), np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (a, b)]
            return pa.RecordBatch.from_arrays([*(pa.array(x[row[edge[:-1]]]) for x in docs_of), *lists], names=["d", "h", "a", "b"])

        for batch in batches:
            for name, part, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if (out := done()) is not None:
                        yield out
                    now, found = name, []
                if part < 0:
                    docs_of = _unpack(block, *DOCS)
                elif kind == 0:
                    places = _unpack(block, *PLACES)
                else:
                    (row, at, form), (of, first, count, value) = places, _unpack(block, *ANSWER)
                    lo, hi = np.searchsorted(of, form), np.searchsorted(of, form, side="right")
                    run, mine = _spread(lo, hi - lo), np.repeat(np.arange(len(form)), hi - lo)
                    hit = value[run] < docs_of[0][row[mine]]
                    run, mine = run[hit], mine[hit]
                    begin = at[mine] + first[run]
                    if len(run):
                        found.append((row[mine], begin, begin + count[run] + LENGTH - 1))
        if (out := done()) is not None:
            yield out

    repeated = rows.mapInArrow(tidy(minimisers), "part int, block binary, k long, v binary").repartitionById(fragments, F.col("part")).mapInArrow(tidy(count), "k long, v binary")
    repeated = repeated.groupBy("k").agg(F.collect_list("v").alias("v"))
    some = rows.join(repeated, "k").select("k", "d", "h", "text", "v")
    gathered = scratch.table(some.mapInArrow(tidy(segments), "slice long, part int, forms binary, places binary"), "gathered", "zstd")
    del rows, repeated, some
    scratch.settle()
    forms = gathered.where("part >= 0").select("slice", "part", "forms").repartitionById(fragments, F.col("part"))
    answers = scratch.table(forms.mapInArrow(tidy(decide), "slice long, part int, answer binary"), "answers")
    del forms
    scratch.settle()
    both = gathered.select("slice", "part", F.lit(0).alias("kind"), F.col("places").alias("block")).union(answers.select("slice", "part", F.lit(1), "answer"))
    both = both.repartition(max(FRAGMENTS, fragments // 4), "slice").sortWithinPartitions("slice", "part", "kind")
    found = both.mapInArrow(tidy(ranges), "d long, h long, a array<long>, b array<long>")
    found = scratch.table(found.groupBy("d", "h").agg(F.first("a").alias("a"), F.first("b").alias("b")), "ranges")  # repeated rows have the same
    scratch.only("ranges")
    return found


def strip(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    from pyspark.sql import types as T

    found = covered(docs, scratch=scratch)
    df = docs.select("doc_id", text_of().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_d"), F.xxhash64("text").alias("_h"))
    df = df.join(small(found), (F.col("_d") == F.col("d")) & (F.col("_h") == F.col("h")), "left").select("doc_id", "text", "a", "b")
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").fields])

    def cut(batches):
        for batch in pieces(batches):
            out = []
            for text, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw, kept, at, spans = text.encode(), [], 0, 0
                for lo, hi in zip(a or (), b or (), strict=True):
                    kept.append(raw[at:lo])
                    spans, at = spans + 1, hi
                kept.append(raw[at:])
                kept = b"".join(kept)
                out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*out, strict=True), kinds)], names=schema.names)

    return df.mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: one row a document."""
    return strip(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


ORACLE = r"""
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS k FROM h WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT w.doc_id, k FROM w JOIN m USING (s) WHERE m.d < w.doc_id),
g AS (SELECT doc_id, k, k - coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k), -1000) > 50 AS new FROM c),
r AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM (SELECT doc_id, k, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS i FROM g) GROUP BY doc_id, i),
p AS (
  SELECT r.doc_id, a, substr(h.x, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS before
  FROM r JOIN h USING (doc_id)),
k AS (SELECT doc_id, string_agg(before, '' ORDER BY a) AS x FROM p GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS e FROM r GROUP BY doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h.x ELSE k.x || substr(h.x, 2 * e + 1) END)) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""

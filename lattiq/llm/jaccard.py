"""N-gram Jaccard join by vertical partitioning, and the groups that its links make.

The global order of shingles is by document frequency (in steps of half an octave), then by hash: rare ones first.

0. Shingles that many documents of a bounded sample have (``frequent``; the sample and the share are parameters) come
   last in the order. They are known to be shared and need no count, so no task has to see all documents of one of them.
   Any order gives the same links: the sample decides on work alone.
1. Every document becomes its set of 64-bit shingle hashes. Shingles are dealt to fragments by hash, packed as binary
   blocks, so a shuffled row carries thousands of them. Each fragment counts document frequencies of all its shingles;
   those of one document only go no further.
2. What is left returns to its document. Two documents of similarity ``t`` share one of the first
   ``n - ceil(t * n) + 1`` shingles in the global order (prefix filter); a document whose prefix has only shingles of its
   own is linked with nothing.
3. Candidate pairs share a prefix shingle and have sizes that allow ``t``. To verify them, the global order is cut into
   fragments at quantiles; the overlap of a pair is counted in each fragment separately and summed per pair.
4. A group of thousands of near copies needs no pair for each two of them: in each of some rounds every document is
   compared with one pivot per prefix shingle, and links contract the graph. All pairs across different components that
   still share a prefix shingle are then compared, so no link between components is lost and none is guessed. Bounds
   leave out pairs that can't reach the threshold: the overlap is at most what either set has from the shared shingle on
   (positional filter), less the shingles right after it that the other set lacks.

Exact copies (equal word sequences) are one class from the start. Nothing is collected on the driver but the fragments'
few limits.

Defined results: a null or wordless text has an empty set and is its own component; fewer than five words are one
shingle; repeated rows are copies; an empty table gives an empty result; a null doc_id takes part but never names a
component; a very long text is one set like others. Columns other than doc_id and text are not read, whatever their names
are. Sets are held as hashes of 64 bits, of which pairs compare the 56 upper ones; equal hashes count as equal shingles.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import Scratch, fragments_for, fresh, pieces, small, texts_of, tidy

WIDTH = 5
#: Similarity, in hundredths.
THRESHOLD = 75
#: Bytes of input to a fragment's task, and the least number of fragments.
FRAGMENT_BYTES, FRAGMENTS = 4 << 20, 32
#: Documents of the sample for frequent shingles, about, and the share of them from which a shingle is frequent.
SAMPLE, SHARE = 20_000, 0.01
#: Documents of a prefix shingle to a task.
HEAVY = 20_000
#: Steps of document frequency; the last one is that of frequent shingles.
LAST_STEP = 127
#: Cuts of the global order for counting overlaps.
CUTS = 4
#: Shingles after a shared one that are looked at before a pair across components becomes a candidate.
AHEAD = 32
#: Rounds of comparisons with pivots before all pairs across components are compared.
ROUNDS = 4
SLICE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base, those of its inverse modulo 2**64, and a random number for each byte."""
    if len(_tables.get("up", ())) < size:
        size = max(size, SLICE + (1 << 18))
        up, down = np.full(size, _BASE, dtype=_U), np.full(size, pow(_BASE, -1, 1 << 64), dtype=_U)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _tables.update(up=up, down=down, byte=np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1))
    return _tables["up"], _tables["down"], _tables["byte"]


def forget() -> None:
    """Drops the tables; a task calls it at its end."""
    _tables.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; texts are words with one space between, none is empty."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    up, down, byte = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(byte[data] * up[: len(data)], out=sums[1:])
    ends = np.flatnonzero(data == 32)
    begins = np.empty_like(ends)
    begins[0], begins[1:] = 0, ends[:-1] + 1
    last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1)  # number of each text's last word
    first = np.concatenate(([0], last[:-1] + 1))
    count = np.maximum(last - first + 2 - width, 1)
    at = np.cumsum(count) - count
    word = np.arange(count.sum()) - np.repeat(at - first, count)
    a, b = begins[word], ends[np.minimum(word + width - 1, np.repeat(last, count))]
    hashes = _mixed((sums[b] - sums[a]) * down[a])
    return [np.unique(hashes[i : i + n]) for i, n in zip(at.tolist(), count.tolist(), strict=True)]


def _normal(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def _key(norm: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(norm, digest_size=8).digest(), "little", signed=True)


def _blocks(group: np.ndarray, key: np.ndarray, tokens: np.ndarray, extra: np.ndarray | None = None):
    """(group, block) of entries that stand in order of group and key: keys, entries of each, tokens, extra bytes."""
    if not len(group):
        return
    new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1]))))
    size = np.diff(np.append(new, len(group))).astype(np.uint32)
    edge = np.flatnonzero(np.concatenate(([True], group[new][1:] != group[new][:-1])))
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(new)], strict=True):
        a, b = int(new[lo]), int(new[hi]) if hi < len(new) else len(group)
        parts = [np.array([hi - lo], dtype=np.uint32), key[new[lo:hi]], size[lo:hi], tokens[a:b]]
        yield int(group[a]), b"".join(p.tobytes() for p in parts) + (extra[a:b].tobytes() if extra is not None else b"")


def _unblock(block: bytes, with_extra: bool = False, kind=np.uint32) -> tuple[np.ndarray, ...]:
    """Key of each entry, tokens, and extra bytes if there are."""
    n, width = int(np.frombuffer(block, np.uint32, 1)[0]), np.dtype(kind).itemsize
    key, size = np.frombuffer(block, np.int64, n, 4), np.frombuffer(block, np.uint32, n, 4 + 8 * n)
    total, at = int(size.sum()), 4 + 12 * n
    out = (np.repeat(key, size), np.frombuffer(block, kind, total, at))
    return (*out, np.frombuffer(block, np.uint8, total, at + width * total)) if with_extra else out


def _batch(schema: T.StructType, kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)


def frequent(docs: DataFrame, width: int = WIDTH, sample: int = SAMPLE, share: float = SHARE) -> np.ndarray:
    """Sorted hashes of the shingles that at least ``share`` of about ``sample`` documents have: at most a document's mean
    number of shingles divided by ``share``."""
    rows = docs.select("text").where("text is not null")
    total = rows.count()

    def count(batches):
        for batch in pieces(batches, limit=SLICE):
            norm = [t for t in map(_normal, texts_of(batch)) if t]
            h, n = np.unique(np.concatenate([np.empty(0, _U), *(shingles(norm, width) if norm else [])]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], names=["h", "n"])
        forget()

    if total > sample:
        rows = rows.sample(sample / total, seed=7)
    least = max(2, int(min(total, sample) * share))
    found = rows.mapInArrow(tidy(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.h for r in found.select("h").collect()], dtype=np.int64).astype(_U))


def sets(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, fragments: int | None = None) -> DataFrame:
    """Rows (key, doc_id, n) of all documents, and rows (key, n, prefix, tokens) of classes that may have a link.

    ``tokens`` are a class's shingles that others have too, as numbers in the global order, ascending; ``prefix`` are the
    first of them. ``doc_id`` and ``prefix`` are null where they don't belong.
    """
    if fragments is None:
        fragments = fragments_for(docs, FRAGMENT_BYTES, FRAGMENTS)
    slots = max(FRAGMENTS // 2, fragments // 2)
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))
    idf = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    ida = pa.from_numpy_dtype(np.int64)
    ida = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}.get(idf.dataType.simpleString(), ida)
    head = [T.StructField("key", T.LongType()), idf, T.StructField("n", T.LongType())]
    kinds = [pa.int64(), ida, pa.int64()]
    one = T.StructType([T.StructField("part", T.IntegerType()), *head, T.StructField("block", T.BinaryType())])
    two = T.StructType([T.StructField("slot", T.IntegerType()), *head, T.StructField("block", T.BinaryType())])
    longs = T.ArrayType(T.LongType())
    three = T.StructType([*head, T.StructField("prefix", longs), T.StructField("tokens", longs)])

    def shred(batches):
        seen: set[int] = set()  # classes whose shingles this task has sent
        often = np.append(known.value, _U(0))  # one more, that stands behind
        for batch in pieces(batches, limit=SLICE):
            norm = [_normal(t) for t in texts_of(batch)]
            keys = [_key(t) for t in norm]
            full = [i for i, t in enumerate(norm) if t]
            size = [0] * len(norm)
            got = shingles([norm[i] for i in full], width) if full else []
            send_key, send = [], []
            for i, h in zip(full, got, strict=True):
                size[i] = len(h)
                if keys[i] not in seen:
                    seen.add(keys[i])
                    send_key.append(keys[i])
                    send.append(h)
            rows = [(k % fragments, k, d, n, None) for k, d, n in zip(keys, batch.column(0).to_pylist(), size, strict=True)]
            if send:
                h = np.concatenate(send)
                key = np.repeat(np.array(send_key, dtype=np.int64), [len(x) for x in send])
                mine = often[np.searchsorted(often[:-1], h)] == h
                # frequent ones go on to their classes' slots
                slot, own, same = key[mine] % slots, key[mine], h[mine]
                order = np.lexsort((own, slot))
                last = np.full(len(own), LAST_STEP, np.uint8)
                rows += [(p % fragments, p, None, None, b) for p, b in _blocks(slot[order], own[order], same[order], last)]
                h, key = h[~mine], key[~mine]
                part = (((h >> _U(32)) * _U(fragments)) >> _U(32)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                rows += [(p, None, None, None, b) for p, b in _blocks(part[order], key[order], h[order])]
            yield _batch(one, [pa.int32(), *kinds, pa.binary()], rows)
        forget()

    def count(batches):
        blocks: dict[int, list[bytes]] = {}
        k2 = [pa.int32(), *kinds, pa.binary()]
        for batch in batches:
            rows = []
            for part, key, doc, n, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None:
                    rows.append((key % slots, key, doc, n, None))
                elif key is not None:
                    rows.append((key, None, None, None, block))
                else:
                    blocks.setdefault(part, []).append(block)
            yield _batch(two, k2, rows)
        for part in list(blocks):
            key, token = (np.concatenate(x) for x in zip(*(_unblock(b, kind=_U) for b in blocks.pop(part)), strict=True))
            by = np.lexsort((key, token))
            token, key = token[by], key[by]
            new = np.concatenate(([True], token[1:] != token[:-1]))
            once = new | np.concatenate(([True], key[1:] != key[:-1]))  # a class counts once
            token, key, new = token[once], key[once], np.flatnonzero(new[once])
            df = np.diff(np.append(new, len(token)))
            df = np.repeat(df, df)
            more = df > 1
            token, key, step = token[more], key[more], np.minimum(2 * np.log2(df[more]), LAST_STEP).astype(np.uint8)
            slot = key % slots
            order = np.lexsort((key, slot))
            yield _batch(two, k2, [(s, None, None, None, b) for s, b in _blocks(slot[order], key[order], token[order], step[order])])

    def prefixes(batches):
        size: dict[int, int] = {}
        keys, order_of = [], []
        k3 = [*kinds, pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for _, key, doc, n, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None:
                    size[key] = n
                    rows.append((key, doc, n, None, None))
                else:
                    k, token, step = _unblock(block, True, _U)
                    keys.append(k)
                    order_of.append((step.astype(_U) << _U(56) | token >> _U(8)).astype(np.int64))
            yield _batch(three, k3, rows)
        if not keys:
            return
        key, place = np.concatenate(keys), np.concatenate(order_of)
        keys.clear()
        order_of.clear()
        by = np.lexsort((place, key))
        key, place = key[by], place[by]
        once = np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]))  # tasks may have sent a class each
        key, place = key[once], place[once]
        new = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key)).tolist()
        rows = []
        for a, b in zip(new, new[1:], strict=False):
            n = size[int(key[a])]
            first = n + (-threshold * n // 100) + 1 - (n - (b - a))
            if first > 0:
                rows.append((int(key[a]), None, n, place[a : a + first], place[a:b]))
            if len(rows) == 2000:
                yield _batch(three, k3, rows)
                rows = []
        yield _batch(three, k3, rows)

    out = docs.select("doc_id", "text").mapInArrow(tidy(shred), one).repartitionById(fragments, F.col("part"))
    return out.mapInArrow(tidy(count), two).repartitionById(slots, F.col("slot")).mapInArrow(tidy(prefixes), three)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, c): the smallest vertex that each vertex of ``edges`` (a, b) reaches; by large and small stars."""
    both = lambda e: e.union(e.select("b", "a"))
    mark, step = None, 0
    edges = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    while True:
        sym = both(edges)
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a")
        star = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step += 1
        edges = scratch.table(star, f"{name}-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        if now == mark:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
        mark = now


def _fits(threshold: int) -> Column:
    """Whether sizes na, nb and what is left from the shared shingle on (ra, rb) allow the threshold."""
    sizes = 100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    return sizes & ((100 + threshold) * F.least("ra", "rb") >= threshold * (F.col("na") + F.col("nb")))


def _fits_ahead(threshold: int) -> Column:
    """The same after a look at the next shingles fa, fb; up to ``seen`` both lists are whole."""
    end = lambda f: F.when(F.size(f) < AHEAD, F.lit((1 << 63) - 1)).otherwise(F.element_at(f, -1))
    seen = F.least(end("fa"), end("fb"))
    lacks = lambda x, y: F.size(F.array_except(F.filter(x, lambda v: v <= seen), F.col(y)))
    most = F.least(F.col("ra") - lacks("fa", "fb"), F.col("rb") - lacks("fb", "fa"))
    return (100 + threshold) * most >= threshold * (F.col("na") + F.col("nb"))


def verified(pairs: DataFrame, classes: DataFrame, cuts: list[int], threshold: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, na, b, nb) whose overlaps, counted in each cut of the global order and summed, reach the threshold."""
    limits = [None, *cuts, None]
    within = lambda lo, hi: lambda x: (F.lit(True) if lo is None else x >= lo) & (F.lit(True) if hi is None else x < hi)
    cut = F.array(*[F.struct(F.lit(k).alias("cut"), F.filter("tokens", within(lo, hi)).alias("t")) for k, (lo, hi) in enumerate(zip(limits, limits[1:], strict=False))])
    cut = classes.select("key", F.explode(cut).alias("x")).select("key", "x.cut", "x.t").where(F.size("t") > 0)
    left = cut.select(F.col("key").alias("a"), "cut", F.col("t").alias("ta"))
    right = cut.select(F.col("key").alias("b"), "cut", F.col("t").alias("tb"))
    partial = pairs.join(left, "a").join(right, ["b", "cut"]).select("a", "na", "b", "nb", F.size(F.array_intersect("ta", "tb")).alias("o"))
    total = partial.groupBy("a", "na", "b", "nb").agg(F.sum("o").alias("o"))
    return total.where(100 * F.col("o") >= threshold * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def groups(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, rounds: int = ROUNDS, fragments: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row a document: doc_id, key (its class), n_shingles, component_id."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    made = scratch.table(sets(docs, threshold, width, fragments), "sets")
    scratch.settle()
    meta = made.where("prefix is null").select("doc_id", "key", "n")
    classes = made.where("prefix is not null").select("key", "n", "prefix", "tokens")
    postings = classes.select("key", "n", F.size("tokens").alias("m"), F.posexplode("prefix").alias("i", "t")).select("key", "n", "t", (F.col("m") - F.col("i")).alias("rest"))
    shared = scratch.table(postings.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    # documents of a heavy shingle are dealt to ``w`` tasks, each of which gets what it is joined with
    heavy = small(shared.where(F.col("df") > HEAVY).select("t", F.ceil(F.col("df") / HEAVY).alias("w")))
    dealt = lambda y: y.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)))
    weight = F.coalesce("w", F.lit(1).cast("long"))
    postings = postings.join(heavy, "t", "left").withColumn("w", weight).withColumn("s", F.pmod(F.xxhash64("key"), F.col("w")))
    postings = scratch.table(postings.join(dealt(shared.select("t", F.ceil(F.col("df") / HEAVY).alias("w"))).drop("w"), ["t", "s"], "left_semi"), "postings")
    in_order = F.explode("tokens").alias("x")
    quantiles = classes.select(in_order).agg(F.percentile_approx("x", [k / CUTS for k in range(1, CUTS)], 1000)).first()[0] or []
    cuts = sorted(set(quantiles))
    labels, links, open_ = None, None, postings.withColumn("c", F.col("key"))
    done = None  # pairs that were compared
    for r in range(rounds + 1):
        if r:  # what shares a shingle with another component
            open_ = postings.join(labels.select(F.col("v").alias("key"), "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
            mixed = open_.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("w").alias("w")).where("lo <> hi")
            open_ = scratch.table(open_.join(dealt(mixed.select("t", "w")).select("t", "s"), ["t", "s"], "left_semi"), f"open{r}")
            if open_.isEmpty():
                break
        names = {"key": "a", "n": "na", "c": "ca", "rest": "ra"}
        if r < rounds:
            best = F.col("rest").cast("long") if not r else F.xxhash64("key", F.lit(r))
            y = dealt(open_.groupBy("t").agg(F.max_by(F.struct("key", "n", "c", "rest"), best).alias("p"), F.max("w").alias("w")))
            y = y.select("t", "s", *[F.col(f"p.{k}").alias(v.replace("a", "b")) for k, v in names.items()])
            x = open_.select("t", "s", *[F.col(k).alias(v) for k, v in names.items()])
            pairs = x.join(y, ["t", "s"]).where("ca <> cb").where(_fits(threshold))
        else:
            ahead = F.slice("tokens", F.size("tokens") - F.col("rest") + 2, AHEAD).alias("f")
            names["f"] = "fa"
            # sets of a heavy shingle meet those of their own and the next size bands: others differ too much in size
            band = F.floor(F.log("n") / (1.01 * math.log(100 / threshold))) if threshold < 100 else F.col("n")
            x = open_.join(classes.select("key", "tokens"), "key").select("t", "s", "w", "key", "n", "c", "rest", ahead, F.when(F.col("w") > 1, band).otherwise(0).cast("long").alias("z"))
            x = scratch.table(x, "ahead").select("t", "s", "w", "z", *[F.col(k).alias(v) for k, v in names.items()])
            z = F.explode(F.when(F.col("w") > 1, F.array(F.col("z") - 1, F.col("z"), F.col("z") + 1)).otherwise(F.array("z")))
            y = dealt(x.select("t", "w", z.alias("z"), *[F.col(v).alias(v[:-1] + "b" if v != "a" else "b") for v in names.values()])).drop("w")
            pairs = x.join(y, ["t", "s", "z"]).where("a < b and ca <> cb").where(_fits(threshold) & _fits_ahead(threshold))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"pairs{r}")
        new = verified(pairs, classes, cuts, threshold, scratch)
        links = scratch.table(new if links is None else links.union(new), f"links{r}")
        done = pairs.select("a", "b") if done is None else done.union(pairs.select("a", "b"))
        labels = scratch.table(components(links, scratch, f"stars{r}"), f"labels{r}")
    group = meta.join(small(labels.withColumnRenamed("v", "key")), "key", "left").withColumn("g", F.coalesce("c", "key")) if labels is not None else meta.withColumn("g", F.col("key"))
    group = scratch.table(group.select("doc_id", "key", "n", "g"), "grouped")
    scratch.only("grouped")
    least = scratch.table(group.where("n > 0").groupBy("g").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).where("m > 1").drop("m"), "least")
    out = group.join(small(least), "g", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "doc_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), own.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: one row a document."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id. Rows without a doc_id stay; of rows that
    repeat both doc_id and words, one stays."""
    scratch = Scratch(spark, "jaccard-stage")
    got = groups(docs, scratch=scratch).where("doc_id is not null").select("doc_id", "key", "component_id")
    got = scratch.table(got, "got")
    gone = scratch.table(got.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(small(gone), "doc_id", "left_anti").select(*names)
    again = scratch.table(got.groupBy("doc_id", "key").agg(F.count("*").alias("m")).where("m > 1").select("doc_id").distinct(), "again")
    if again.isEmpty():
        return out
    mark = fresh(docs, "_mark")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(low, r"[\x20\x09-\x0D]+", -1), "")
    once = out.join(again, "doc_id", "left_semi").withColumn(mark, F.xxhash64(words)).dropDuplicates(["doc_id", mark]).select(*names)
    return out.join(small(again), "doc_id", "left_anti").select(*names).union(once)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, w[k:k + least(5, len(w)) - 1] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  WITH RECURSIVE r(v, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
  SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(r.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.v = w.doc_id
"""

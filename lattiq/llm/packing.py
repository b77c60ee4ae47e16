"""Best-fit decreasing packing of token pieces into sequences.

Piece lengths are whole numbers up to the capacity, so the packing of all pieces follows from how many there are of each
length: a table of at most ``capacity`` numbers, whatever the input. ``plan`` runs best-fit decreasing over it on the
driver: bins of equal remaining capacity are held in runs, a segment tree over remaining capacities finds the tightest
open one in logarithmic time, and a run of equal pieces goes to a run of equal bins at once. The result is the packing
that best-fit decreasing over single pieces gives. Every piece then finds its place from its rank among pieces of its
length, counted in buckets so that no task sees all pieces of a frequent length.

Defined results: a null or empty text is one piece with the closing id alone; repeated rows are packed each; ties among
equal lengths go by bucket, doc_id and piece; an empty table gives an empty result. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import Scratch, pieces, texts_of, tidy
from .tokens import chunks, definition_of

CAPACITY = 2048
END = b"\0\0\0\0"
#: Rows to a bucket of pieces, about, without and with their ids, and least number of buckets.
BUCKET_ROWS, BUCKET_ROWS_IDS, BUCKETS = 20_000, 4_000, 64


class Capacities:
    """A segment tree over remaining capacities 1..size; a leaf holds runs (first bin, bins) with just that left."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [0] * (2 * self.width)  # runs below each node
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _add(self, left: int, by: int) -> None:
        at = left + self.width
        while at:
            self.open[at] += by
            at >>= 1

    def push(self, left: int, run: tuple[int, int]) -> None:
        if left and run[1]:
            self.runs[left].append(run)
            self._add(left, 1)

    def pop(self, left: int) -> tuple[int, int]:
        self._add(left, -1)
        return self.runs[left].pop()

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` with an open bin, or 0."""
        at = least + self.width
        if self.open[at]:
            return least
        while at > 1:  # up to the first node with something to its right, then down to its smallest leaf
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank, pieces to a bin, first bin, offset in the bin): best-fit decreasing."""
    tree, out, bins = Capacities(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left:
                first, n = tree.pop(left)
            else:
                left, first, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            each = left // length
            used = min(n, -(-todo // each))
            placed = min(todo, used * each)
            out.append((length, rank, rank + placed - 1, each, first, capacity - left))
            tree.push(left, (first + used, n - used))
            short = used * each - placed  # pieces that the last bin could still take
            tree.push(left - each * length, (first, used - (short > 0)))
            if short:
                tree.push(left - (each - short) * length, (first + used - 1, 1))
            rank, todo = rank + placed, todo - placed
    return out


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    definition = docs.sparkSession.sparkContext.broadcast(definition_of(tokenizer_path))
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(fields).fields])
    step = 4 * capacity

    def work(batches):
        encoder = chunks(definition.value)
        for batch in pieces(batches, limit=2 << 20):
            row, cut, held = [], [], []
            for i, ids in enumerate(encoder.ids(texts_of(batch))):
                ids += END
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(i)
                    cut.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                if with_ids:
                    held.append(ids)
            cols = [pa.array(c, k) for c, k in zip(zip(*cut, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            if with_ids:
                ends = np.cumsum([0, *(c[2] for c in cut)], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(held), "<i4"))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *cols], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(work), schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """The pieces with sequence_id (from 0, gapless) and offset in the sequence."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    cut = scratch.table(tokenised(docs, tokenizer_path, capacity, with_ids), "pieces")
    buckets = max(BUCKETS, -(-cut.count() // (BUCKET_ROWS_IDS if with_ids else BUCKET_ROWS)))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = scratch.table(cut.groupBy("length", "_b").agg(F.count("*").alias("_n")), "counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "_b", F.coalesce(before, F.lit(0)).alias("_base"))
    schema = "length long, _lo long, _hi long, _each long, _first long, _at long"
    places = spark.createDataFrame(plan(lengths, capacity), schema)
    places = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_lo", "_hi", "_each", "_first", "_at"))).alias("_p"))
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("_k", rank).join(base, ["length", "_b"]).withColumn("_rank", F.col("_k") + F.col("_base"))
    placed = ranked.join(F.broadcast(places), "length")  # at most `capacity` rows
    placed = placed.withColumn("_s", F.get(F.filter("_p", lambda p: (p["_lo"] <= F.col("_rank")) & (F.col("_rank") <= p["_hi"])), F.lit(0)))
    k = F.col("_rank") - F.col("_s._lo")
    sequence = F.col("_s._first") + F.floor(k / F.col("_s._each"))
    offset = F.col("_s._at") + F.pmod(k, F.col("_s._each")) * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"), *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids, ids: the sequences' content, from ``pack(..., with_ids=True)``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    return rows.select("sequence_id", F.col("x.doc_id").alias("doc_ids"), F.flatten("x.ids").alias("ids"))


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: one row a piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their ids and places: what a sequence holds stands in the result (``sequences``)."""
    return pack(docs, _path(), with_ids=True)

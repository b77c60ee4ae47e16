"""Training-order materialisation: token sequences in a keyed random order, in shards of equal rows.

1. Documents are dealt to buckets by the hash of their id and text. A bucket's documents, by id, make one stream of ids,
   each closed by id 0, which is cut into sequences of equal length; the last one of a bucket is padded. Sequences are
   numbered without gaps, bucket by bucket. Numbers follow from the documents and the number of buckets alone, not from
   the files or tasks that they come in.
2. A keyed Feistel network over the next even power of two, with cycle-walking back into the range, gives each number its
   slot: a permutation that needs no table and that any worker can compute.
3. Slots are dealt by ranges: a partition holds some whole shards, shard ``s`` holds slots ``s * rows`` to
   ``(s + 1) * rows - 1`` in order, one file each. Slot k is row ``k % rows`` of shard ``k // rows``. Ids are not
   compressed and have one width, all of a shard in one page: every row lies at a fixed stride (``place_of``), so a reader
   can begin anywhere, read on in sequence, and resume.

Sequences travel compressed. Shards are even by construction, whatever the documents are. Defined results: a null or
empty text gives its closing id; very long texts run over many sequences; repeated rows are written each (one bucket has
them); null ids come first in their bucket; an empty table gives no shard. Columns other than doc_id (a whole number) and
text are not read, whatever their names are.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, fragments_for, pieces, small, text_of, texts_of, tidy
from .tokens import chunks, definition_of

LENGTH, ROWS, ROUNDS = 2048, 1024, 6
#: Bytes of texts to a bucket; shards to a partition at least, and partitions at most, which then hold more shards.
BUCKET_BYTES, SHARDS, PARTITIONS = 16 << 20, 4, 50_000
#: Chunks that a worker keeps encoded: 150 MB, about.
KEPT = 800_000
KEY = b"training order 1"
_U = np.uint64


def _keys(key: bytes, rounds: int) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(key + bytes([r]), digest_size=8).digest(), "little") for r in range(rounds)]


def _feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    for k in keys:
        f = (right ^ _U(k)) * _U(0xFF51AFD7ED558CCD)
        f ^= f >> _U(32)
        f *= _U(0xC4CEB9FE1A85EC53)
        f ^= f >> _U(29)
        left, right = right, left ^ (f & mask)
    return left << _U(half) | right


def slots(numbers: np.ndarray, total: int, key: bytes = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each number below ``total``."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    keys, out = _keys(key, rounds), _feistel(numbers.astype(_U), half, _keys(key, rounds))
    while len(over := np.flatnonzero(out >= total)):  # cycle-walking: under four steps on average
        out[over] = _feistel(out[over], half, keys)
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, idx, first_doc, start, n_tokens, body): body is the compressed ids, two bytes each if they fit."""
    definition = docs.sparkSession.sparkContext.broadcast(definition_of(tokenizer_path))
    buckets = buckets or fragments_for(docs, BUCKET_BYTES, 1)

    def work(batches):
        import zstandard

        encoder, pack = chunks(definition.value, KEPT), zstandard.ZstdCompressor(level=2)
        width = np.dtype(encoder.width)
        bucket, idx, held, begins, at, total = None, 0, [], [], 0, 0  # held: ids not yet cut; begins: (place, doc) of texts that reach into them

        def cut(last: bool):
            nonlocal held, begins, at, idx
            ids = np.concatenate(held) if held else np.empty(0, width)
            whole = len(ids) // length * length
            ends = [*range(length, whole + 1, length), *([len(ids)] if last and len(ids) > whole else [])]
            place, docs_at, rows = np.array([b for b, _ in begins], dtype=np.int64), [d for _, d in begins], []
            for k, end in enumerate(ends):
                row = ids[k * length : end]
                own = int(np.searchsorted(place, at + k * length, side="right")) - 1
                body = np.zeros(length, width)
                body[: len(row)] = row
                rows.append((bucket, idx, docs_at[own], at + k * length - int(place[own]), len(row), pack.compress(body.tobytes())))
                idx += 1
            done = ends[-1] if ends else 0
            held, at = [ids[done:]], at + done
            begins = begins[max(0, int(np.searchsorted(place, at, side="right")) - 1) :]
            return rows

        def batch(rows):
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays(list(map(pa.array, cols, kinds)), names=["bucket", "idx", "first_doc", "start", "n_tokens", "body"])

        for b in pieces(batches, limit=3 << 20):
            rows = []
            for name, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoder.ids(texts_of(b)), strict=True):
                if name != bucket:
                    rows += cut(True)
                    bucket, idx, held, begins, at, total = name, 0, [], [], 0, 0
                ids = np.append(np.frombuffer(ids, "<u4"), 0).astype(width)
                begins.append((total, doc))
                held.append(ids)
                total += len(ids)
            yield batch(rows + cut(False))
        yield batch(cut(True))

    rows = docs.select(F.pmod(F.xxhash64("doc_id", text_of()), F.lit(buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long"), "text")
    rows = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", F.xxhash64(text_of()))
    return rows.mapInArrow(tidy(work), "bucket int, idx long, first_doc long, start long, n_tokens int, body binary")


def write(docs: DataFrame, path: str, tokenizer_path: str, length: int = LENGTH, rows: int = ROWS, key: bytes = KEY, scratch: Scratch | None = None) -> DataFrame:
    """Writes the shards to ``path`` and gives them: slot, shard, row, number, first_doc, start, n_tokens, ids_crc32, ids."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "order")
    cut = sequences(docs, tokenizer_path, length)
    cut.write.option("compression", "none").parquet(scratch.path("stream"))  # bodies are compressed already
    scratch.names.add("stream")
    kinds, cut = cut.schema, None
    scratch.settle()  # texts that were dealt to buckets
    cut = spark.read.schema(kinds).parquet(scratch.path("stream"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("far", F.floor(F.col("bucket") / 1024))
    counts = scratch.table(counts, "counts")
    far = counts.groupBy("far").agg(F.sum("n").alias("n")).select("far", before(Window.orderBy("far")).alias("base"))  # a row to 1024 buckets
    near = counts.select("bucket", "far", before(Window.partitionBy("far").orderBy("bucket")).alias("own"))
    base = scratch.table(near.join(far, "far").select("bucket", (F.col("base") + F.col("own")).alias("base")), "base")
    total = counts.agg(F.sum("n")).first()[0] or 0
    shards = -(-total // rows)
    each = max(SHARDS, -(-shards // PARTITIONS))

    def placed(batches):
        for b in batches:
            n = b.column(0).to_numpy()
            slot = slots(n, total, key) if len(n) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // rows), *b.columns], names=["slot", "shard", *b.schema.names])

    def opened(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in pieces(batches, "body", 2 << 20):
            at = b.schema.get_field_index("body")
            ids = [unpack.decompress(x) for x in b.column(at).to_pylist()]
            crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], crc, pa.array(ids, pa.binary())], names=[*b.schema.names[:at], "ids_crc32", "ids"])

    fields = "number long, first_doc long, start long, n_tokens int"
    numbered = cut.join(small(base), "bucket").select((F.col("base") + F.col("idx")).alias("number"), "first_doc", "start", "n_tokens", "body")
    dealt = numbered.mapInArrow(placed, f"slot long, shard long, {fields}, body binary").repartitionById(max(1, -(-shards // each)), F.floor(F.col("shard") / each).cast("int"))
    ready = dealt.sortWithinPartitions("shard", "slot").mapInArrow(tidy(opened), f"slot long, shard long, {fields}, ids_crc32 long, ids binary").withColumn("row", F.pmod("slot", F.lit(rows)).cast("int"))
    # one page to a shard's ids, as they are
    plain = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.size": str(1 << 30), "parquet.page.row.count.limit": str(rows), "parquet.block.size": str(1 << 30), "parquet.page.size.row.check.max": str(rows)}
    ready.write.mode("overwrite").partitionBy("shard").options(**plain).parquet(path)
    return spark.read.schema(f"slot long, {fields}, ids_crc32 long, ids binary, row int, shard long").parquet(path)


def place_of(row: int, rows: int, end: int, length: int = LENGTH, width: int = 2) -> tuple[int, int]:
    """First and last byte + 1 of a row's ids in a shard's file of ``rows`` rows, whose column of ids ends at ``end``: the
    footer's offset and size of that column. Each row takes its ids and four bytes for their size."""
    at = end - (rows - row) * (4 + length * width) + 4
    return at, at + length * width


def read_from(spark: SparkSession, path: str, slot: int, count: int, rows: int = ROWS) -> DataFrame:
    """``count`` sequences from ``slot`` on, in order; only their shards are opened."""
    last = (slot + count - 1) // rows
    found = spark.read.parquet(path).where(F.col("shard").between(slot // rows, last))
    return found.where(F.col("slot").between(slot, slot + count - 1)).orderBy("slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: one row a sequence: its slot, shard and row, where it begins, its length and its bytes' checksum."""
    import public_tokenizers

    scratch = Scratch(spark, "order")
    made = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.path("shards"), public_tokenizers.path("word_bpe_49k.json"), scratch=scratch)
    scratch.only()
    return made.select("slot", "shard", "row", "number", F.col("first_doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")

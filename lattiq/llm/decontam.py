"""Benchmark decontamination over a distributed positional inverted index.

1. Index: one pass over the texts writes a posting (document, position, term) for every word that the benchmark uses,
   and one closing posting a document whose position is its number of words.
2. Rarity: terms are counted over the whole index.
3. Lists are intersected from the rarest terms: the postings of the rarest term of each window give alignments of an
   item with a document (word position minus item position); those of the second rarest must agree with the alignment;
   then the postings of the documents that are left must agree for every word. Runs of at least a window's length of
   agreeing positions are exact phrase matches. Proximity matches come from the same index (``proximity``).

Only DataFrame functions run. No list is collected: a term in every document is just many rows, and what is broadcast
(terms, windows, documents that are left) is counted first and joined by a shuffle if it is large.

Defined results: a null text has no words; an item without words has no windows; an item that comes twice counts once;
a null item_id reads as an empty string; repeated documents each get a row; empty tables give an empty result or zero
hits. Columns other than doc_id, text and item_id, text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, small, text_of, without

WINDOW = 13
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No word: it holds a character that separates words.
CLOSING = "\x01"


def words(text: Column) -> Column:
    """Maximal runs of ASCII digits, letters (A-Z lowered) and characters beyond ASCII."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP, -1), "")


def terms_of(items: DataFrame) -> DataFrame:
    """Rows (item, p, term, n) of the items' words; ``item`` is the id as a string."""
    text = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(text_of()).alias("w")).distinct()
    text = text.select("item", F.xxhash64("item", F.array_join("w", " ")).alias("i"), "w", F.size("w").alias("n"))
    return text.select("item", "i", "n", F.posexplode("w").alias("p", "w")).withColumn("term", F.xxhash64("w"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (d, h, pos, term) of the words in ``vocabulary`` (w, term); h tells texts of equal ids apart."""
    closing = docs.sparkSession.range(1).select(F.lit(CLOSING).alias("w"), F.lit(0).cast("long").alias("term"))
    tokens = F.concat(words(F.col("_t")), F.array(F.lit(CLOSING)))
    rows = docs.select(F.col("doc_id").alias("d"), text_of().alias("_t"))
    rows = rows.select("d", F.xxhash64("_t").alias("h"), F.posexplode(tokens).alias("pos", "w"))
    return rows.join(small(vocabulary.union(closing)), "w").select("d", "h", "pos", F.when(F.col("w") != CLOSING, F.col("term")).alias("term"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.d").eqNullSafe(F.col(f"{b}.d")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def phrase_matches(index: DataFrame, terms: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Maximal exact matches (d, h, item, a, b): words a to b-1 of the document stand as in the item."""
    freq = index.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("freq"))
    freq = scratch.table(freq, "freq")
    ranked = scratch.table(terms.join(small(freq), "term", "left"), "ranked")
    size = F.least(F.lit(window), F.col("n"))
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - size + 1), F.least(F.col("p"), F.col("n") - size)))
    by = Window.partitionBy("i", "s").orderBy("freq", "p")
    cells = ranked.select("i", "p", "term", "freq", starts.alias("s"))
    cells = cells.withColumn("r", F.row_number().over(by)).withColumn("known", F.min(F.col("freq").isNotNull()).over(Window.partitionBy("i", "s"))).where("known and r <= 2")
    at = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    probes = cells.groupBy("i", "s").agg(at(1, "p").alias("p1"), at(1, "term").alias("t1"), at(2, "p").alias("p2"), at(2, "term").alias("t2"))
    probes = scratch.table(probes.select("i", "p1", "t1", "p2", "t2").distinct(), "probes")
    found = index.join(small(probes), F.col("term") == F.col("t1"))
    found = found.select("d", "h", "i", (F.col("pos") - F.col("p1")).alias("diag"), "p2", "t2").distinct()
    seconds = index.join(small(scratch.table(probes.select(F.col("t2").alias("term")).distinct(), "seconds")), "term", "left_semi")
    pair = found.where("t2 is not null").alias("x").join(seconds.alias("y"), _same("x", "y") & (F.col("y.pos") == F.col("diag") + F.col("p2")) & (F.col("term") == F.col("t2")))
    left = pair.select("x.d", "x.h", "i", "diag").union(found.where("t2 is null").select("d", "h", "i", "diag")).distinct()
    left = scratch.table(left, "aligned")
    there = scratch.table(left.select("d", "h").distinct(), "there")
    near = index.where(F.col("term").isNotNull()).alias("x").join(small(there).alias("y"), _same("x", "y"), "left_semi")
    wanted = left.join(small(ranked.select("i", "item", "n", "p", "term")), "i").withColumn("at", F.col("diag") + F.col("p")).where("at >= 0")
    agree = wanted.alias("x").join(near.alias("y"), _same("x", "y") & (F.col("at") == F.col("y.pos")) & (F.col("x.term") == F.col("y.term")))
    agree = agree.select("x.d", "x.h", "item", "i", "n", "diag", "p").distinct()
    run = F.col("p") - F.row_number().over(Window.partitionBy("d", "h", "i", "diag").orderBy("p"))
    runs = agree.withColumn("run", run).groupBy("d", "h", "item", "i", "n", "diag", "run").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return runs.where(F.col("hi") - F.col("lo") + 1 >= size).select("d", "h", "item", (F.col("diag") + F.col("lo")).alias("a"), (F.col("diag") + F.col("hi") + 1).alias("b")).distinct()


def proximity(index: DataFrame, first: Column, second: Column, within: int) -> DataFrame:
    """Documents and positions where two terms (word hashes) stand at most ``within`` words apart."""
    x, y = index.where(F.col("term") == first).alias("x"), index.where(F.col("term") == second).alias("y")
    cell = lambda c: F.floor(F.col(c) / within)
    y = y.select("y.d", "y.h", F.col("y.pos").alias("q"), F.explode(F.array(*[cell("y.pos") + k for k in (-1, 0, 1)])).alias("c")).alias("y")
    out = x.withColumn("c", cell("pos")).alias("x").join(y, _same("x", "y") & (F.col("x.c") == F.col("y.c"))).where(F.abs(F.col("pos") - F.col("q")) <= within)
    return out.select(F.col("x.d").alias("doc_id"), F.col("pos").alias("first_pos"), F.col("q").alias("second_pos")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """One row a document: doc_id, h (hash of its text), n_words, n_hit, n_items, items_sha256, contaminated, whole.

    ``whole``: a window of ``window`` words occurs, not only items that are shorter than that.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    terms = scratch.table(terms_of(items), "terms")
    index = scratch.table(build_index(docs, scratch.table(terms.select("w", "term").distinct(), "vocabulary")), "index")
    hits = scratch.table(phrase_matches(index, terms.drop("w"), scratch, window), "hits")
    before = F.max("b").over(Window.partitionBy("d", "h").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.lit(0))))
    names = F.collect_set("item")
    per = hits.withColumn("fresh", fresh).groupBy("d", "h").agg(
        F.sum("fresh").alias("n_hit"), F.max(F.col("b") - F.col("a") >= window).alias("whole"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(names), ","), 256).alias("items_sha256")
    )
    per = small(scratch.table(per, "per"))
    closing = scratch.table(index.where(F.col("term").isNull()).select("d", "h", "pos"), "documents")
    scratch.only("per", "documents")
    out = closing.alias("x").join(per.alias("y"), _same("x", "y"), "left")
    n_words, n_hit = F.col("pos").cast("long"), F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        F.col("x.d").alias("doc_id"), F.col("x.h").alias("h"), n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
        F.coalesce("whole", F.lit(False)).alias("whole"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: one row a document."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contamination(read("documents"), read("benchmark")).drop("h", "whole")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which a whole window of an item occurs, however long they are, and contaminated ones; others stay.

    Items of fewer words than a window can be common phrases: they count by their share of a document only.
    """
    scratch = Scratch(spark, "decontam")
    bad = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=scratch).where("whole or contaminated")
    bad = scratch.table(bad.select(F.col("doc_id").alias("_d"), F.col("h").alias("_b")).distinct(), "bad")
    scratch.only("bad")
    return without(docs, bad, "text")


ORACLE = r"""
WITH docw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
itemw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS n, w[s:s + least(13, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM itemw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
docg AS (
  SELECT doc_id, n, s, w[s:s + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docw, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT d.doc_id, i.item_id, d.s, d.n FROM docg d JOIN win i ON d.n = i.n AND d.g = i.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT docw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

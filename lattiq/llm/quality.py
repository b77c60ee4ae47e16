"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Every document becomes a vector of transformed text statistics. For each (lang, source) the estimate starts twice, from
medians and median deviations and from mean and covariance of all rows, then takes concentration steps until the
determinant falls no more: keep the share ``H`` of the rows that are nearest by Mahalanobis distance, take mean and covariance of these, and
repeat. The result of the lesser determinant stays. Steps and determinants have no floor but the grid's ``NOISE``. A
document is rejected if its squared distance is above ``cutoff``; for that the covariance is scaled so that the group's
median agrees with the chi-square median (by ``CONSISTENT`` at least), and ``FLOOR`` is added, as most groups have no spread
at all in three of the statistics.

Only DataFrame functions run. The statistics table (one narrow row a document) is written once; each step aggregates
it to a few numbers a group with map-side combining, so a hot source costs no more than its share of the rows.
Values are held as whole numbers of 1/``GRID``, which makes sums exact and the verdict the same at every partitioning.

Defined results: a null text has no words and fails the base rule; null lang or source form groups of their own;
repeated rows are judged alike; a very long text is one row like others; groups of fewer than ``MIN_GROUP`` rows use the estimate of their language, and if that
is small as well, that of all rows; an empty table gives an empty result. Columns other than
doc_id, text, lang and source are not read, whatever their names are.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, small, text_of, without

SPACE = r"[\x20\x09-\x0D]+"
GRID = 256
H = 0.75
#: A group's concentration steps end when its determinant falls no more, or after so many.
MOST_STEPS = 30
MIN_GROUP = 50
#: 1 - 1e-4 quantile of chi-square with five degrees of freedom, and its median.
CUTOFF, MEDIAN = 25.745, 4.351
#: What the covariance of the nearest ``H`` of normal rows in five dimensions falls short by.
CONSISTENT = 1.41
#: Standard deviation that is added for the verdict: differences below it are not held against a document. Each statistic
#: can go over the cutoff by itself (a table's separators, one mark in eight characters, stay below; repeats above a
#: share of 0.3 fail the base rule already).
FLOOR = (0.12, 0.27, 0.26, 0.2, 0.03)
DIMS = len(FLOOR)
NOISE = (2 / GRID,) * DIMS


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_upper, n_repeat_words."""
    text = F.col("_text")
    df = docs.select(*keep, text_of().alias("_text"))
    df = df.withColumn("_w", F.array_remove(F.split(text, SPACE, -1), ""))
    df = df.withColumn("_l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    n = F.size("_h")
    df = df.withColumn(
        "_g",
        F.when(n >= 8, F.transform(F.sequence(F.lit(0), n - 8), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(8)]))).otherwise(F.array().cast("array<bigint>")),
    ).drop("_h")
    # only texts in which a window comes back pay for the sort
    df = df.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    ).drop("_g")
    near = lambda x, j: F.coalesce(F.get("_s", j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("_s", j + 1)["g"] == x["g"], F.lit(False))
    df = df.withColumn("_r", F.sort_array(F.filter(F.transform("_s", lambda x, j: F.when(near(x, j), x["i"])), lambda i: i.isNotNull()))).drop("_s")
    covered = F.aggregate(F.transform("_r", lambda x, j: F.least(F.lit(8), F.coalesce(F.get("_r", j + 1) - x, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_r")


def vector() -> list[Column]:
    """The transformed statistics, as whole numbers of 1/GRID."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    grown = lambda part, of, by: F.log(F.lit(1.0) + by * F.col(part) / of)
    # what is measured on a short text scatters: word length is drawn to that of a plain word, shares are drawn to none
    parts = [
        F.log((F.col("word_chars") + 100) / (words + 20)),
        grown("n_symbols", chars, 20),
        grown("n_dup_lines", F.col("n_lines") + 2, 5),
        grown("n_repeat_words", words + 20, 5),
        grown("n_upper", chars + 100, 5),
    ]
    return [F.round(x * GRID).cast("long").alias(f"x{k}") for k, x in enumerate(parts)]


def _quantile(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The least value whose cumulative share of a group's rows reaches ``share``; from counts a value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_c", F.sum("_n").over(w.orderBy(value))).withColumn("_t", F.sum("_n").over(w))
    return run.where(F.col("_c") >= F.col("_t") * share).groupBy(*keys).agg(F.min(value).alias(name))


def _moments(rows: DataFrame) -> DataFrame:
    """Mean m*, and lower triangle of the covariance c*, of each group, in plain units."""
    pairs = [(a, b) for a in range(DIMS) for b in range(a + 1)]
    g = rows.groupBy("g").agg(
        F.count("*").alias("n"),
        *[F.sum(f"x{a}").alias(f"s{a}") for a in range(DIMS)],
        *[F.sum(F.col(f"x{a}") * F.col(f"x{b}")).alias(f"p{a}{b}") for a, b in pairs],
    )
    m = [F.col(f"s{a}") / F.col("n") for a in range(DIMS)]
    return g.select("g", *[(m[a] / GRID).alias(f"m{a}") for a in range(DIMS)], *[((F.col(f"p{a}{b}") / F.col("n") - m[a] * m[b]) / (GRID * GRID)).alias(f"c{a}{b}") for a, b in pairs])


def _factor(est: DataFrame, floor: tuple[float, ...] = NOISE, scale: Column | None = None) -> DataFrame:
    """Adds the Cholesky factor l* of the covariance times ``scale`` plus the floor."""
    s = scale if scale is not None else F.lit(1.0)
    for a in range(DIMS):
        for b in range(a + 1):
            c = F.col(f"c{a}{b}") * s + F.lit(floor[a] ** 2 if a == b else 0.0)
            rest = c - reduce(add, [F.col(f"l{a}{k}") * F.col(f"l{b}{k}") for k in range(b)], F.lit(0.0))
            est = est.withColumn(f"l{a}{b}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if a == b else rest / F.col(f"l{b}{b}"))
    return est.select("g", *[f"m{a}" for a in range(DIMS)], *[f"l{a}{b}" for a in range(DIMS) for b in range(a + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for a in range(DIMS):
        r = F.col(f"x{a}") / GRID - F.col(f"m{a}")
        y.append((r - reduce(add, [F.col(f"l{a}{k}") * y[k] for k in range(a)], F.lit(0.0))) / F.col(f"l{a}{a}"))
    return reduce(add, [v * v for v in y])


def estimates(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """Location and Cholesky factor a group ``g``; ``vectors`` has g and x*."""
    dims = F.explode(F.array(*[F.struct(F.lit(a).alias("d"), F.col(f"x{a}").alias("v")) for a in range(DIMS)]))
    long = vectors.select("g", dims.alias("e")).select("g", "e.*")
    mid = _quantile(long, ["g", "d"], "v", 0.5, "med")
    mid = small(scratch.table(mid, "mid"))
    mad = _quantile(long.join(mid, ["g", "d"]).withColumn("v", F.abs(F.col("v") - F.col("med"))), ["g", "d"], "v", 0.5, "mad").join(mid, ["g", "d"])
    at = lambda name, d: F.max(F.when(F.col("d") == d, F.col(name)))
    start = mad.groupBy("g").agg(
        *[(at("med", a) / GRID).alias(f"m{a}") for a in range(DIMS)],
        *[F.pow(at("mad", a) * 1.4826 / GRID, 2).alias(f"c{a}{a}") for a in range(DIMS)],
        *[F.lit(0.0).alias(f"c{a}{b}") for a in range(DIMS) for b in range(a)],
    )
    begun = lambda k, est: est.withColumn("g", F.concat(F.lit(k), F.col("g")))
    est = scratch.table(_factor(begun("0", start)).unionByName(_factor(begun("1", _moments(vectors)))), "est0")
    twice = vectors.withColumn("g", F.explode(F.array(*[F.concat(F.lit(k), F.col("g")) for k in "01"])))
    binned = lambda e: twice.join(small(e), "g").withColumn("b", F.floor(F.log2(_distance() + 1e-3) * 64))
    spread = reduce(add, [F.log(f"l{a}{a}") for a in range(DIMS)]).alias("v")
    raws, volumes = [], []
    for step in range(1, MOST_STEPS + 1):
        near = binned(est)
        edge = small(scratch.table(_quantile(near, ["g"], "b", H, "edge"), f"edge{step}"))
        raws.append(scratch.table(_moments(near.join(edge, "g").where(F.col("b") <= F.col("edge"))), f"raw{step}"))
        made = _factor(raws[-1])
        volumes.append(scratch.table(made.select("g", spread), f"volume{step}"))
        if step > 1:  # groups that go on
            last = volumes[-2].withColumnRenamed("v", "u")
            made = made.join(volumes[-1].join(last, "g").where(F.col("v") < F.col("u") - 1e-6), "g", "left_semi")
        est = scratch.table(made, f"est{step}")
        if est.isEmpty():
            break
    all_raws = reduce(DataFrame.unionByName, [x.withColumn("step", F.lit(k)) for k, x in enumerate(raws)])
    all_volumes = reduce(DataFrame.unionByName, [x.withColumn("step", F.lit(k)) for k, x in enumerate(volumes)])
    # ties go to the first start, then to the earlier step
    best = all_volumes.groupBy(F.substring("g", 2, 1 << 30).alias("of")).agg(F.min(F.struct("v", "g", "step")).alias("x"))
    raw = scratch.table(all_raws.join(best.select("of", "x.g", "x.step"), ["g", "step"]).drop("step"), "best")
    half = _quantile(binned(_factor(raw)), ["g"], "b", 0.5, "half")
    scale = F.greatest(F.pow(F.lit(2.0), F.col("half") / 64) / MEDIAN, F.lit(CONSISTENT))
    final = raw.join(half, "g").drop("g").withColumnRenamed("of", "g")
    return scratch.table(_factor(final, FLOOR, scale), "final")


def judge(docs: DataFrame, cutoff: float = CUTOFF, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, statistics, base_failed, distance (squared, of the MCD estimate), kept."""
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = statistics(docs, "doc_id", "lang", "source").withColumn("base_failed", base).select("*", *vector())
    stats = scratch.table(stats, "stats")
    # a group is (level, lang, source); small groups lean on their language, and that on all rows
    kinds = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("nl", F.sum("n").over(Window.partitionBy("lang")))
    level = F.when(F.col("n") >= MIN_GROUP, 2).when(F.col("nl") >= MIN_GROUP, 1).otherwise(0)
    name = F.to_json(F.struct(level.alias("k"), F.when(level >= 1, F.col("lang")).alias("l"), F.when(level == 2, F.col("source")).alias("s")))
    kinds = small(scratch.table(kinds.select("lang", "source", name.alias("g")), "kinds"))
    own = lambda df: df.join(kinds.withColumnsRenamed({"lang": "_l", "source": "_s"}), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")
    wide = own(stats)
    # estimates of a fallback level are made from all rows it covers
    levels = small(scratch.table(kinds.select("g").distinct(), "levels"))
    xs = [f"x{a}" for a in range(DIMS)]
    names = [
        F.to_json(F.struct(F.lit(2).alias("k"), F.col("lang").alias("l"), F.col("source").alias("s"))),
        F.to_json(F.struct(F.lit(1).alias("k"), F.col("lang").alias("l"))),
        F.lit('{"k":0}'),
    ]
    vectors = stats.select(F.explode(F.array(*names)).alias("g"), *xs).join(levels, "g", "left_semi")
    final = small(estimates(vectors, scratch))
    out = wide.join(final, "g", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: one row a document with its counts and verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("distance")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Verdicts join back on doc_id and the text's hash, so repeated rows stay."""
    scratch = Scratch(spark, "quality")
    mark = F.xxhash64(text_of(), F.col("lang"), F.col("source"))
    rows = docs.select(F.struct("doc_id", mark.alias("h")).alias("doc_id"), "text", "lang", "source")
    bad = judge(rows, scratch=scratch).where(~F.col("kept")).select(F.col("doc_id.doc_id").alias("_d"), F.col("doc_id.h").alias("_b")).distinct()
    bad = scratch.table(bad, "bad")
    scratch.only("bad")
    return without(docs, bad, "text", "lang", "source")

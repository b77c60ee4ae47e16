"""Personal data by candidate generation and gradient-boosted trees.

Generators with high recall propose spans, which may overlap. Those of the fixed kinds (``BASE``) are judged by their
rules alone. Those of the further kinds (``MORE``) get features of their format and of the words before them; boosted
trees score them, and a threshold that is calibrated on held-out rows selects. A selected span gives way to a fixed kind
that it overlaps and to a better one of the further kinds that stays.

The trees are fitted on a sample of ``SAMPLE`` labelled candidates, which a seeded generator writes (there are no labels
for personal data in the tables); the features are those of the main path. Then everything is one expression a row: no
shuffle, no Python on executors. Only texts with a mark of personal data (an at sign, a digit, a spelt-out address) are
searched by the expressions.

Defined results: a null text is empty; each row of the input gives one row, repeated ones too; a very long text is searched
whole (the work on its spans grows with their square); spans of equal scores go by place, then kind; an empty table gives
an empty result. Columns other than doc_id and text are not read, whatever their names are. Positions are code points.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import text_of

SAMPLE = 2400
#: Fixed kinds, in the contract's order. Possessive parts and looks behind keep the search linear; matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A spelt-out dot; a label after which an address can't end; one after which it can.
_DOT = r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?"
_INNER, _LAST = r"(?![A-Za-z]{2})[A-Za-z0-9-]++", rf"[A-Za-z]{{2,}}+(?:[A-Za-z0-9-]++(?={_DOT}[A-Za-z0-9]))?"
#: Further kinds, proposed generously.
MORE = {
    "spelt": rf"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]*+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:(?:{_DOT}{_INNER})*+{_DOT}{_LAST})++",
    "tel": r"(?<![0-9+.(-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = [*BASE, *MORE]
#: Every generator's matches contain it.
MARK = r"[@0-9]|[(\[]at[)\]]|[(\[]dot[)\]]|\x20dot\x20"
BEFORE = 24
#: Words before a span that speak for it (by kind) or against it.
WORDS = {
    "call": r"(?i)(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|t[ée]l[ée]phone|handy)[^A-Za-z0-9]{0,6}$",
    "mail": r"(?i)(?:mail|contact|write|reach|correo|courriel)[^A-Za-z0-9]{0,6}(?:me|us|to)?[^A-Za-z0-9]{0,4}$",
    "number": r"(?i)(?:ssn|social\x20security|iban|account|konto|compte|cuenta)[^A-Za-z0-9]{0,6}(?:no|nr|number)?[^A-Za-z0-9]{0,4}$",
    "other": r"(?i)(?:version|ver|v|order|invoice|part|isbn|item|model|ref|page|lot|sku|serial|\$|€|£|#)[^A-Za-z0-9]{0,4}$",
}


def _luhn(text: Column) -> Column:
    digits = F.reverse(F.regexp_replace(text, r"[\x20-]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]+", ""))


RULES = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"),
    "card": _luhn,
    "phone": lambda m: _digits(m).between(9, 15),
}


def _ruled(kind: str) -> Column:
    return F.filter(f"_s_{kind}", lambda x: RULES[kind](x["m"]))


def located(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds for each kind an array of (a, k, b, m): start, number of the kind, end and match, in order.

    The gaps between matches come from splitting by the same expression; starts are sums of what lies before.
    """
    for kind, p in patterns.items():
        look = F.col("_any")
        df = df.withColumn(f"_m_{kind}", F.when(look, F.regexp_extract_all(text, F.lit(p), F.lit(0))))
        df = df.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.transform(F.split(text, p, -1), F.length)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)

    def spans(kind: str) -> Column:
        matches, gaps, k = F.col(f"_m_{kind}"), F.col(f"_g_{kind}"), F.lit(KINDS.index(kind))

        def span(m: Column, i: Column) -> Column:
            a = total(F.slice(gaps, F.lit(1), i + 1)) + total(F.transform(F.slice(matches, F.lit(1), i), F.length))
            return F.struct(a.alias("a"), k.alias("k"), (a + F.length(m)).alias("b"), m.alias("m"))

        return F.when(F.size(matches) > 0, F.transform(matches, span))

    empty = F.array().cast("array<struct<a:int,k:int,b:int,m:string>>")
    for kind in patterns:
        df = df.withColumn(f"_s_{kind}", F.coalesce(spans(kind), empty))
    return df.drop(*[f"_{x}_{kind}" for kind in patterns for x in "mg"])


def features(kind: Column, match: Column, before: Column) -> list[Column]:
    """Numbers that describe a candidate's format and context."""
    number = lambda c: c.cast("double")
    digits = F.regexp_replace(match, "[^0-9]+", "")
    return [
        number(kind),
        number(F.length(digits)),
        number(F.length(match)),
        number(F.length(F.regexp_replace(match, r"[^\x20.()-]+", ""))),
        number(F.length(F.regexp_replace(match, r"[^.]+", ""))),
        number(match.contains("(")),
        number(F.length(F.regexp_replace(digits, r"([0-9])(?=.*\1)", ""))),
        number(F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1))),
        *[number(before.rlike(p)) for p in WORDS.values()],
        number(before.rlike(r"[A-Za-z0-9]$")),
    ]


def sample(n: int = SAMPLE, seed: int = 11) -> list[tuple[int, str, str, int]]:
    """(kind, match, text before, label) of written candidates."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    good = {"tel": ["tel: ", "phone ", "call me at ", "Fax: ", "mobile "], "spelt": ["mail: ", "contact ", "write to ", "reach me: "], "ssn": ["SSN: ", "social security number "], "iban": ["IBAN: ", "account no. "]}
    bad = ["version ", "order #", "invoice ", "part ", "ISBN ", "$ ", "model ", "ref. "]
    out = []
    for i in range(n):
        kind, yes = list(MORE)[i % len(MORE)], r.random() < 0.5
        sep = r.choice(" .-")
        if kind == "tel":
            m = r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"{d(2)}{sep}{d(4)}{sep}{d(4)}"]) if yes else r.choice([f"{d(4)}{sep}{d(3)}{sep}{d(3)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}"])
        elif kind == "spelt":
            m = f"{w()}{r.choice([' (at) ', '(at)', ' [at] ', ' at '])}{w()}{r.choice([' (dot) ', '(dot)', ' dot '])}{r.choice(['com', 'org', 'net', 'de'])}" if yes else f"{w()} at {w()} dot {w()}"
        elif kind == "ssn":
            m = f"{r.randint(1, 8)}{d(2)}-{d(2)}-{d(4)}" if yes else f"{r.choice('09')}{d(2)}-{d(2)}-{d(4)}"
        else:
            m = f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}" + (f" {d(2)}" if yes else "") if yes else f"{w()[:2].upper()}{d(2)}{w()[:4].upper().ljust(4, 'X')}{d(4)}"
        cue = (r.choice(good[kind]) if r.random() < 0.6 else w() + " ") if yes else (r.choice(bad) if r.random() < 0.6 else w() + " ")
        out.append((KINDS.index(kind), m, f"{w()} {w()} {cue}"[-BEFORE:], int(yes)))
    return out


_fitted: dict[tuple, Boosted] = {}


def model(spark: SparkSession, n: int = SAMPLE) -> Boosted:
    """The trees, fitted once a driver; features of the sample are made by the main path's expressions."""
    if (n,) not in _fitted:
        rows = spark.createDataFrame(sample(n), "kind int, match string, before string, label int")
        got = rows.select("label", *[x.alias(f"f{k}") for k, x in enumerate(features(F.col("kind"), F.col("match"), F.col("before")))]).collect()
        table = np.array([list(r) for r in got], dtype=float)
        _fitted[(n,)] = Boosted().fit(table[:, 1:], table[:, 0])
    return _fitted[(n,)]


def _overlap(x: Column, y: Column) -> Column:
    return (x["a"] < y["b"]) & (y["a"] < x["b"])


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """_keep (a struct of the columns ``keep``), _t (the text), ``base`` and ``more``: arrays of (a, k, b) in order; more has the scores too."""
    spark = docs.sparkSession
    trees = model(spark)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"), text_of().alias("_t")).withColumn("_any", F.col("_t").rlike(MARK))
    df = located(df, "_t", BASE | MORE)
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["a"], x["k"], x["b"]))
    base = F.concat(*[_ruled(k) for k in BASE])
    df = df.withColumn("base", F.sort_array(bare(base)))

    def described(x: Column) -> Column:
        before = F.substring(F.col("_t"), F.greatest(F.lit(1), x["a"] - BEFORE + 1), F.least(x["a"], F.lit(BEFORE)))
        return F.struct(x["a"].alias("a"), x["k"].alias("k"), x["b"].alias("b"), F.array(*features(x["k"], x["m"], before)).alias("f"))

    df = df.withColumn("_c", F.transform(F.concat(*[F.col(f"_s_{k}") for k in MORE]), described))
    scored = F.transform("_c", lambda x: F.struct(x["a"].alias("a"), x["k"].alias("k"), x["b"].alias("b"), trees.column(lambda f: F.get(x["f"], F.lit(f))).alias("score")))
    df = df.withColumn("_c", F.filter(scored, lambda x: x["score"] >= trees.threshold))
    df = df.withColumn("_c", F.filter("_c", lambda x: ~F.exists("base", lambda y: _overlap(x, y))))
    # the best first; one that overlaps a span that stays goes
    first = F.sort_array(F.transform("_c", lambda x: F.struct((-x["score"]).alias("less"), x["a"].alias("a"), x["k"].alias("k"), x["b"].alias("b"))))
    none = F.array().cast("array<struct<a:int,k:int,b:int,score:double>>")
    add = lambda kept, x: F.when(F.exists(kept, lambda y: _overlap(x, y)), kept).otherwise(F.concat(kept, F.array(F.struct(x["a"].alias("a"), x["k"].alias("k"), x["b"].alias("b"), (-x["less"]).alias("score")))))
    df = df.withColumn("more", F.when(F.size("_c") > 0, F.sort_array(F.aggregate(first, none, add))).otherwise(none))
    return df.select("_keep", "_t", "base", "more")


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, counts of the fixed kinds, base_sha256, spans."""
    df = find(docs, "doc_id")
    names = F.array(*map(F.lit, KINDS))
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"].cast("string"), x["b"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    both = F.sort_array(F.concat("base", F.transform("more", lambda x: F.struct(x["a"], x["k"], x["b"]))))
    return df.select("_keep.doc_id", *map(count, range(len(BASE))), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(both).alias("spans"))


def redact(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """The documents with every span's text replaced."""
    df = find(docs, *docs.columns)
    spans = F.sort_array(F.concat("base", F.transform("more", lambda x: F.struct(x["a"], x["k"], x["b"]))))
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        new = F.concat(s["t"], F.substring(F.col("_t"), s["at"] + 1, F.greatest(F.lit(0), x["a"] - s["at"])), F.when(x["a"] >= s["at"], mark).otherwise(""))
        return F.struct(new.alias("t"), F.greatest(s["at"], x["b"]).alias("at"))

    text = F.aggregate(spans, zero, step, lambda s: F.concat(s["t"], F.substring(F.col("_t"), s["at"] + 1, F.length("_t"))))
    new = F.when(F.size(spans) > 0, text).otherwise(F.col("_keep.text")).alias("text")
    return df.select(*[new if c == "text" else F.col(f"_keep.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: one row a document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

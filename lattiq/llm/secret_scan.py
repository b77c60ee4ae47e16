"""Secret scans with a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query (``trigrams``). Over every slice of texts an index of the
named trigrams is built; postings are intersected and joined as the queries say, and only texts that satisfy a rule's
query are verified with its expression. Rules without mandatory trigrams (``hex``) scan every text. Whole texts are
read; there is no shuffle, and memory is bounded by a slice of about 2 MB or the longest text.

Defined results: a null text is empty; each row of the input gives one row, repeated ones too; spans of different kinds
may overlap, those that begin together stand in the kinds' order; a very long text is read whole; an empty table gives an
empty result. Columns other than doc_id and text are not read by ``scan``, whatever their names are.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, pieces, texts_of, tidy
from .trigrams import Index, query_of, trigrams_in

#: Kinds that the contract fixes, in its order: expression, and which matches stay.
BASE = {
    "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]{16,}", lambda m: True),
}
_LINES = r"(?:[\x09-\x0D\x20]|\\[nr])++"
#: A private key through its END line. Without one: the header's fields and the base64 lines that follow; a last short one
#: if it is padded. Line ends may be written as escapes.
_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:-{0,4}[^-])*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_LINES}(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_LINES}[A-Za-z0-9+/=]{{16,}}+)*+(?:{_LINES}[A-Za-z0-9+/]+={{1,2}})?)"
)
#: Kinds of well-known token formats, after those of the contract.
MORE = {
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", lambda m: True),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", lambda m: True),
    "maps": (r"AIza[0-9A-Za-z_-]{35}", lambda m: True),
    "pay": (r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", lambda m: True),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda m: True),
    "pem": (_PEM, lambda m: True),
    "login": (r"://[^\x00-\x20/:@]++:[^\x00-\x20/:@]++@[A-Za-z0-9]", lambda m: True),
}
KINDS = [*BASE, *MORE]
RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
MARK = "[SECRET]"


@cache
def rules() -> list[tuple]:
    """(kind, compiled expression, filter, trigram query) of each rule."""
    return [(k, re.compile(p), keep, query_of(p)) for k, (p, keep) in (BASE | MORE).items()]


@cache
def _index() -> Index:
    return Index(set().union(*(trigrams_in(r[3]) for r in rules())))


def spans(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, number of the kind, end) of every text's secrets, in order; code points."""
    index = _index()
    index.fill(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for n, (_, expression, keep, query) in enumerate(rules()):
        for i in index.find(query).tolist():
            out[i] += [(m.start(), n, m.end()) for m in expression.finditer(texts[i]) if keep(m)]
    for x in out:
        x.sort()
    return out


def digest(found: list[tuple[int, int, int]]) -> tuple:
    told = lambda xs: ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in xs)
    base = [x for x in found if x[1] < len(BASE)]
    count = [sum(x[1] == n for x in base) for n in range(len(BASE))]
    return *count, hashlib.sha256(told(base).encode()).hexdigest(), told(found)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by MARK."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and the columns of RESULT."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(RESULT).fields])

    def work(batches):
        for batch in pieces(batches):
            rows = [digest(x) for x in spans(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string() if k > 2 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))]], names=schema.names)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(work), schema)


def redact(docs: DataFrame) -> DataFrame:
    """The documents, their columns as they were, with secrets in text replaced; n_chars follows where it is there."""
    schema, names = docs.schema, docs.columns

    def work(batches):
        for batch in pieces(batches):
            texts, cols = texts_of(batch), list(batch.columns)
            found = spans(texts)
            new = {i: redacted(texts[i], x) for i, x in enumerate(found) if x}
            if new:
                put = lambda name, f: cols.__setitem__(names.index(name), pa.array([f(new[i]) if i in new else v for i, v in enumerate(cols[names.index(name)].to_pylist())], cols[names.index(name)].type))
                put("text", str)
                if "n_chars" in names:
                    put("n_chars", len)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(work), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: one row a document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced."""
    return redact(docs)


def _sql() -> str:
    """DuckDB SQL: matches by the same expressions, places from the lengths of matches and of what lies between them."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    parts = []
    for k, (kind, (p, _)) in enumerate((BASE | MORE).items()):
        p = p.replace("*+", "*").replace("++", "+").replace("}+", "}")
        if kind == "assign":
            names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
            p = f"({names})" + p[p.index("))") + 2 :]
        p = p.replace("'", "''")
        value, least = ("regexp_extract_all(t, '%s', 2)" % p, 12) if kind == "assign" else ("m", 18 if kind == "access" else 0)
        parts.append(
            f"""SELECT doc_id, unnest(list_filter(list_transform(m, lambda x, i: {{'s': list_sum(list_transform(gaps[1:i], lambda g: length(g)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda g: length(g))), 0), 'k': {k}, 'kind': '{kind}', 'n': length(x), 'keep': length(vals[i]) >= {least}}}), lambda x: x.keep)) AS x
  FROM (SELECT doc_id, m, {value} AS vals, regexp_split_to_array(t, '{p}') AS gaps FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m FROM d) WHERE len(m) > 0)"""
        )
    told = "string_agg(concat(x.kind, ':', CAST(x.s AS BIGINT), ':', CAST(x.s + x.n AS BIGINT)), ',' ORDER BY x.s, x.k)"
    count = lambda k: f"CAST(coalesce(count(*) FILTER (x.k = {k}), 0) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex, {told} FILTER (x.k < 3) AS base, {told} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _sql()

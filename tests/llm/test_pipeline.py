"""The pipeline's stages over rows with nulls and copies, against plain versions; and the driver's entry."""

from collections import Counter

import corpus_pipeline
from lattiq.llm import decontam, jaccard, packing, quality, queries, secret_scan

from .test_operators import LOW, PATH, WORD, encoded, linked, naive_packing, plain


def test_stages_keep_columns(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, "nothing of these words stands in any text at all")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.collect()
        assert stage(spark, none, f"file://{tmp_path}").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "jaccard", "decontamination", "secrets", "packing"]


def test_quality_stage_drops_what_is_rejected(spark, docs):
    kept = Counter((r.doc_id, r.n_words) for r in quality.judge(docs).collect() if r.kept)
    out = quality.stage(spark, docs, "")
    assert Counter(r.doc_id for r in out.collect()) == Counter(d for d, _ in kept.elements())


def test_jaccard_stage_keeps_one_of_each_group(spark, docs):
    want = Counter(d for d, n, c in set(linked(plain(docs))) if d is not None and (n == 0 or d == c))
    got = Counter(r.doc_id for r in jaccard.stage(spark, docs, "").collect() if r.doc_id is not None)
    assert got == want


def test_decontamination_stage(spark, docs, tmp_path):
    """Long documents with a whole window go too; short items count by their share only; items may be null, tables empty."""
    texts = [t for _, t in plain(docs)]
    part = " ".join(next(WORD.findall(t) for t in texts if len(WORD.findall(t)) > 5000)[4000:4013])  # 13 of 12,000 words
    items = [(1, part), (None, " ".join(next(WORD.findall(t) for t in texts if 40 < len(WORD.findall(t)) < 60)[:30])), (2, "ab"), (3, None), (4, "")]
    path = f"file://{tmp_path}/benchmark.parquet"
    spark.createDataFrame(items, "item_id long, text string").write.parquet(path)
    want = []
    for d, t in plain(docs):
        w = WORD.findall(t.translate(LOW))
        long = any(g in {tuple(w[k : k + 13]) for k in range(len(w) - 12)} for _, x in items for i in [WORD.findall((x or "").translate(LOW))] for g in {tuple(i[k : k + 13]) for k in range(len(i) - 12)})
        if not long and not ("ab" in w and 20 * w.count("ab") >= len(w)):
            want.append(d)
    out = [r.doc_id for r in decontam.stage(spark, docs, f"file://{tmp_path}").collect()]
    assert len(want) < docs.count() - 2 and Counter(out) == Counter(want)
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(path)
    assert decontam.stage(spark, docs, f"file://{tmp_path}").count() == docs.count()


def test_run_matches_its_parts(spark):
    """The pipeline over the smallest tables: what stays by plain versions, and texts that come back from the sequences."""
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keep = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    rows = [(d, t) for d, t in plain(docs) if d in keep]
    keep = {d for d, n, c in linked(rows) if d == c}
    grams = lambda t: {tuple(w[k : k + 13]) for w in [WORD.findall(t.translate(LOW))] for k in range(len(w) - 12)}
    bench = set().union(*(grams(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    rest = {d: t for d, t in plain(docs) if d in keep and not grams(t) & bench}
    clean = {d: secret_scan.redacted(t, x) for (d, t), x in zip(rest.items(), secret_scan.spans(list(rest.values())), strict=True)}
    want = {d: encoded(t) for d, t in clean.items()}
    pieces = [(d, k, 2048 * k, ids[2048 * k : 2048 * (k + 1)]) for d, ids in want.items() for k in range(-(-len(ids) // 2048))]
    assert sorted((r.doc_id, r.piece, r.start, list(r.ids)) for r in got) == sorted(pieces)
    assert len({r.sequence_id for r in got}) == len(naive_packing([len(x) for *_, x in pieces], 2048))
    whole = packing.sequences(spark.createDataFrame(got)).collect()
    assert Counter(i for s in whole for i in s.ids) == Counter(i for ids in want.values() for i in ids)
    marked = next(d for d, t in clean.items() if secret_scan.MARK in t)
    ids, mark = [i for r in sorted(got, key=lambda r: r.piece) if r.doc_id == marked for i in r.ids], encoded(secret_scan.MARK)[:-1]
    assert any(ids[k : k + len(mark)] == mark for k in range(len(ids)))


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_oracles_are_sql():
    import __spark_entry__ as entry

    assert all(isinstance(x, str) for x in entry.oracle_sql().values())

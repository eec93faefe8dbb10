"""The pipeline's stages against brute force on the given documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from tallyhouse.llm import toxicity
from tallyhouse.llm.common import table
from test_llm import SF, brute_components, brute_spans, check_packing


def test_stages(spark, scratch):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "pii", "best_fit_packing"]
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{scratch}/{i}")
        frames.append(spark.read.parquet(f"{scratch}/{i}"))
    assert all(f.columns == docs.columns for f in frames[:4])
    clean, single, private, packed = frames[1:]

    scored = toxicity.classify(docs, table(spark, SF, "labels"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}

    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    keep = {d for d, (_, c) in brute_components(rows).items() if d == c}
    assert {r.doc_id for r in single.collect()} == keep

    texts = {r.doc_id: r.text for r in single.collect()}
    for r in private.collect():
        assert brute_spans(r.text or "") == [] and (brute_spans(texts[r.doc_id] or "") or r.text == texts[r.doc_id])
        assert r.text is None or r.n_chars == len(r.text)
    assert private.count() == single.count()

    pieces = packed.collect()
    totals = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(totals) == keep
    check_packing(pieces, totals)


def test_near_duplicates_are_told_apart_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b.upper()), (9, a + " more"), (3, c), (5, c + " more"), (None, b), (None, "alone " * 9), (7, ""), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    key = lambda r: (r[0] or 0, r[1] or "", r[1] is None)
    want = [(5, a), (5, b.upper()), (3, c), (None, "alone " * 9), (7, ""), (7, None), (None, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)


def test_run_is_the_chain_of_stages(spark):
    from __spark_entry__ import queries
    got = queries()["pipeline"](spark, SF)
    assert got.select("doc_id").distinct().count() > 0 and "sequence_id" in got.columns

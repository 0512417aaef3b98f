"""The pipeline's stages against what they are for."""

from __future__ import annotations

import corpus_pipeline
from conftest import SMALL


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    extra = spark.createDataFrame(
        [(10 ** 6, None, None, None, 0), (10 ** 6 + 1, "12 34", "en", "s", 5),
         (10 ** 6 + 2, docs.first()["text"], "en", "s", 1)], docs.schema)
    docs = docs.union(extra).union(docs.limit(1))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert number == 4 or out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "language_id":
            assert docs.count() == before + 2
        if name == "near_dedup":
            assert docs.count() == docs.distinct().count() < before
            assert docs.where(f"doc_id >= {10 ** 6}").count() == 0
    assert docs.selectExpr("max(offset + length)").first()[0] <= 2048


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the small boat went down the river and nobody at the harbour had seen who was steering it that {} evening"


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_rows_are_judged_by_themselves(spark):
    """Null ids, and one id for several texts: each row stays or goes for its own text."""
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    passage = max((r["text"] for r in benchmark), key=lambda t: len(t.split()))
    clean = " ".join(f"quiet{i} harbour{i * 7}" for i in range(60))
    other = " ".join(f"winter{i} orchard{i * 3}" for i in range(60))
    rows = [(None, clean), (None, clean), (None, passage), (5, clean), (5, other), (6, other + " end"), (6, passage),
            (7, PROSE.format("late") * 9), (8, PROSE.format("late") * 9), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    kept = stage_of("near_dedup")(spark, docs, SMALL)
    assert kept.columns == docs.columns
    texts = sorted((r["text"] or "", r["doc_id"] or 0) for r in kept.collect())
    # The smallest id stays, null ids last; texts without words are no duplicates.
    assert texts == sorted([(clean, 5), (other, 5), (passage, 6), (PROSE.format("late") * 9, 7), ("", 0), ("", 9)])
    left = sorted((r["text"] or "", r["doc_id"] or 0) for r in stage_of("decontaminate")(spark, docs, SMALL).collect())
    assert left == sorted((t or "", i or 0) for i, t in rows if t != passage)


def test_language_stage_keeps_figures_and_unlabelled_texts(spark):
    prose = [(i, PROSE.format(f"w{i}") * 3, "en") for i in range(12)]
    figures = [(100 + k, " ".join(f"{i * 37 % 1000:03d}.{i % 10}|" for i in range(200)) + words, "en") for k, words in
               enumerate((" xqz total", " Σ kg", " vwx 7 qqj"))]
    none = [(200, "1234 !!! 5678", "en"), (201, None, "en"), (202, "", None)]
    for label in (lambda lang: lang, lambda lang: None):
        docs = spark.createDataFrame([(i, t, label(lang), "s", 1) for i, t, lang in prose + figures + none], COLUMNS)
        kept = {r["doc_id"] for r in stage_of("language_id")(spark, docs, SMALL).collect()}
        assert kept == {i for i, _, _ in prose + figures}

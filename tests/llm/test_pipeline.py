"""The whole pipeline on empty tables and on rows of every odd kind."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path, spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = {"en": [f"en{a}ing" for a in "abcdefghij"], "de": [f"{a}schen" for a in "klmnopqrst"]}
    rows = [(i, " ".join(rng.choice(words[x], 60)), x, "s", 1) for i, x in enumerate(["en", "de"] * 40)]
    rows += [(None, rows[0][1] + " more", "en", None, None), (None, None, None, None, None), (500, None, "en", "s", 0), (501, "", "de", "s", 0), (502, " \n ", None, "s", 3), (3, rows[3][1], "de", "s", 1), (3, rows[5][1], "de", "t", 1)]
    rows += [(600, " ".join(rng.choice(words["en"], 40_000)), "en", "s", 9), (601, rows[10][1] + " write to me@mail.example", "en", "s", 9)]
    clash = {"score": F.lit("x"), "text_hash": F.lit(1), "base": F.lit(2), "spans": F.lit("y"), "found_": F.lit(0), "component": F.lit(0), "lang_pred": F.lit("en"), "toxic": F.lit(1)}
    docs = spark.createDataFrame(rows, DOCS).withColumns(clash)
    sf = write(spark, tmp_path, docs, spark.createDataFrame([(1, 1, 0), (None, 1, 1)], LABELS))
    kept = docs
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:-1], (5, None, None, None), strict=False):
        out = stage(spark, kept, sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        kept = spark.read.parquet(path).withColumns(clash)
        texts = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert 600 in texts and 0 in texts and not {500, 501, 502} & set(texts), name
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 3").count() <= 2
    assert "me@mail.example" not in " ".join(texts.values())
    pieces = corpus_pipeline.pack(spark, kept, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}

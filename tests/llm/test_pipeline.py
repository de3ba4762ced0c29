"""The corpus pipeline stage by stage on a small table."""

import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import llm_cases as cases
from ledgerlift.llm import langid

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_work_on_what_is_left(spark, tmp_path):
    rows = cases.documents()
    path = str(tmp_path)
    cases.frame(spark).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(pipeline.STAGES)

    one = spark.createDataFrame(stages["language_id"](spark, docs, path).collect(), docs.schema)
    assert one.columns == docs.columns
    assert one.where("text is null or not text rlike '[A-Za-z]'").count() == 0

    two = stages["near_copies"](spark, docs, path).collect()
    roots = cases.near_components(rows)
    assert sorted(r.doc_id for r in two if r.doc_id is not None) == sorted({c for _, c in roots.values()})
    assert sum(r.doc_id is None for r in two) == 2

    three = stages["repeated_passages"](spark, docs, path).collect()
    want = cases.without_repeats(rows, 35)
    assert sorted((r.doc_id is not None, r.doc_id, r.text or "") for r in three) == sorted((i is not None, i, t) for i, t, *_ in want)
    assert all(r.text is None or r.n_chars == len(r.text) for r in three)

    four = stages["mixture"](spark, docs, path)
    assert four.columns == docs.columns

    last = pipeline.run(spark, path)
    assert last.agg(F.sum("length")).first()[0] > 0
    assert last.where("length > 4096 or offset + length > 4096").count() == 0


def test_language_stage_keeps_long_documents(spark, tmp_path):
    rng = np.random.default_rng(8)
    # two languages that share most of their words
    both = ["".join(rng.choice(list("abcdefghijklm"), 7)) for _ in range(2000)]
    words = {lang: both + ["".join(rng.choice(list("nopqrstuvwxyz"), 7)) for _ in range(500)] for lang in ("en", "fr")}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, text(lang, 150), lang, "s", 0) for i in range(80) for lang in [("en", "fr")[i % 2]]]
    held = [i for i in range(100, 140) if zlib.crc32(str(i).encode()) % 4 == 2]
    sizes = {i: (("en", "fr")[n % 2], (300, 40_000, 400_000)[n // 2]) for n, i in enumerate(held[:6])}
    rows += [(i, text(lang, n), lang, "s", 0) for i, (lang, n) in sizes.items()]
    assert len(sizes) == 6 and len(rows[-1][1]) > 3_000_000
    path = str(tmp_path)
    cases.frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = dict(pipeline.STAGES)["language_id"](spark, docs, path)
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= set(sizes)
    learned = langid.learn(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.identify(docs.where("doc_id >= 100"), learned).collect()}
    assert all(got[i].lang_pred == lang for i, (lang, _) in sizes.items())
    scores = [got[i].score for i in sizes]
    assert min(scores) > max(scores) / 4


def test_pipeline_of_an_empty_table(spark, tmp_path):
    cases.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0

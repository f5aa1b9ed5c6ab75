"""Every operator on empty tables, on hard cases and on tables with more columns whose names clash."""

from collections import Counter

import pytest

import corpus_pipeline
from factloom import llm

#: All that read documents or pages; test_hard_negatives has the cases of the one that reads embeddings.
NAMES = sorted(set(llm.OPERATORS) - {"op13_hard_negatives"})


def _rows(df):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_gives_no_rows(spark, corpora, name):
    assert llm.queries()[name](spark, corpora["empty"]).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_hard_cases_keep_every_row_and_ignore_other_columns(spark, corpora, name):
    found = _rows(llm.queries()[name](spark, corpora["hard"]))
    source = "pages" if name.startswith("op8_") else "documents"
    if not name.startswith("op5_"):
        assert sum(found.values()) == spark.read.parquet(f"{corpora['hard']}/{source}.parquet").count()
    if not name.startswith(("op2_", "op5_", "op6_", "op12_")):  # these learn from or group rows whose order is open
        assert _rows(llm.queries()[name](spark, corpora["extra"])) == found
    else:
        assert llm.queries()[name](spark, corpora["extra"]).count() == sum(found.values())


@pytest.mark.parametrize("corpus", ["empty", "hard"])
def test_the_pipeline_runs(spark, corpora, corpus):
    found = corpus_pipeline.run(spark, corpora[corpus])
    assert (found.count() > 0) == (corpus == "hard")


def test_the_pipeline_ignores_other_columns(spark, corpora):
    tokens = lambda corpus: Counter((r.doc_id, r.n) for r in corpus_pipeline.run(spark, corpora[corpus]).groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect())
    assert tokens("extra") == tokens("hard")


def test_stages_keep_other_columns_as_they_are(spark, corpora):
    docs = spark.read.parquet(f"{corpora['extra']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, corpora["extra"])
        assert found.columns == docs.columns, name
        assert found.where("n_words = 'clash' AND n_removed = 'clash' AND block = 'clash'").count() == found.count() > 0

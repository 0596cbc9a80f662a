"""The pipeline's stages against brute force on a small table, and the registered queries at the smallest scale."""

import pytest

import corpus_pipeline
from assayer.llm import entries, pseudonyms
from tests.llm.conftest import prose
from tests.llm.test_table_operators import brute_groups

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, near copies, short texts, a benchmark passage and a card number."""
    passage, path = prose(30, 900), str(tmp_path_factory.mktemp("sf"))
    rows = [(i, prose(120 + i, 300 + i), "en", "s", 0) for i in range(40)]
    rows += [(100 + i, " ".join([*prose(120, 300).split()[:-1], f"end{i}"]), "en", "s", 0) for i in range(5)]
    rows += [(200, prose(100, 500) + " " + passage, "en", "s", 0), (201, prose(90, 501) + " 4111 1111 1111 1111", "en", "s", 0)]
    rows += [(300, prose(10, 1), "en", "s", 0), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_decisions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = brute_groups([(i, t) for i, t in texts.items() if i < 300], 5, 80)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {groups[i][1] for i in got} == {g for _, g, _ in groups.values()} - {200}
    assert len({groups[i][1] for i in got}) == len(got)
    worker = pseudonyms.Pseudonymiser(corpus_pipeline.SHOWN_KEY.encode())
    assert all(r.text == worker.text(texts[i])[0] and r.n_tokens == len(r.ids) for i, r in got.items())
    assert "4111 1111" not in got[201].text


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


@pytest.mark.parametrize("name", sorted(set(entries.QUERIES) - {"op6_spaced_seeds", "op8_token_rollup", "op12_spelling_variants"}))
def test_queries_return_every_document(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = entries.QUERIES[name](spark, SMALL)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())

"""Every stage on odd rows and on an empty table."""

import pytest

import corpus_pipeline
from tests.llm.brute import near_components
from tests.llm.conftest import rows
from tidemark.llm import lines


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels")
    table = [(1, 1, 0), (6, 1, 0), (9, 0, 0), (11, 1, 1), (3, None, 1), (None, 1, 0), (99, 0, 0)]
    spark.createDataFrame(table, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_and_empty_tables(spark, odd_docs, no_docs, labelled, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_docs, labelled)
    before = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    after = rows(out.select("doc_id", "text")) if name != "pack" else rows(out.select("doc_id").distinct())
    empty = stage(spark, no_docs, labelled)
    assert empty.count() == 0 and empty.columns == out.columns
    if name == "pack":
        assert {i for i, in after} == {i for i, _ in before}
        return
    assert out.columns == odd_docs.columns and set(after) <= set(before)
    if name == "exact_dedup":
        bare = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
        assert len(after) == len({bare(t) for _, t in before}) == len({bare(t) for _, t in after})
    if name == "near_dedup":
        kept = {i for i, _, _, keep in near_components(before) if keep}
        assert {i for i, _ in after} == kept | {None}


def test_line_operators_on_odd_and_empty_tables(odd_docs, no_docs):
    for unit, least in (("line", 1), ("run", 1), ("paragraph", 1)):
        removed = lines.repeated(odd_docs, unit, least)
        again = lines.cleaned(odd_docs, removed)
        assert again.count() == odd_docs.count() and again.drop("kept_spans").columns == odd_docs.columns
        empty = lines.repeated(no_docs, unit, least)
        assert empty.count() == 0 and lines.cleaned(no_docs, empty).count() == 0

"""The pipeline's exact stage leaves one row a text."""

from fixtures import awkward, clashing, make, plain

import corpus_pipeline
from weirlog.llm import exact_dedup


def test_one_row_a_text(spark):
    rows = [(None, "x y", "b"), (None, "x y", "a"), (3, "p q", "a"), (4, "p q", "a"), (4, "p q", "a"), (5, "z", "c"), (5, "w", "c")]
    found = corpus_pipeline.drop_exact_copies(spark, make(spark, rows).repartition(3), "")
    assert plain(found, "doc_id", "text", "source") == sorted([(None, "x y", "a"), (4, "p q", "a"), (5, "z", "c"), (5, "w", "c")], key=repr)
    assert exact_dedup.drop_copies(make(spark, rows)).count() == 6


def test_columns_and_tables_without_repeats(spark):
    docs = clashing(awkward(spark))
    found = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in found.collect()) == [0, 2, 3, 4, 6, 7, 8, 9]
    assert corpus_pipeline.drop_exact_copies(spark, make(spark, [(1, "a", "s"), (2, "a", "s")]), "").count() == 1

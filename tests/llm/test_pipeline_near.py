"""The pipeline's near-duplicate stage: five-word shingles at 0.8, not the op6 contract's three at 0.9."""

import test_dedup
from fixtures import make, words

import corpus_pipeline
from weirlog.llm import ngram_join


def five_words(text):
    w = words((text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def test_near_copies_between_the_limits_of_op6_and_the_stage(spark):
    """450 words with m scattered edits: 5 words at 0.8 link up to m = 9 (of 446 shingles), 3 words at 0.9 only up to 7."""
    rows = []
    for k, m in enumerate((7, 8, 9, 10, 11)):
        base = [f"d{k}w{i}" for i in range(450)]
        copy = [f"d{k}edit{i}" if i % 40 == 20 and i // 40 < m else w for i, w in enumerate(base)]
        rows += [(10 * k, " ".join(base), "s"), (10 * k + 1, " ".join(copy), "s")]
    docs = make(spark, rows)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == [0, 10, 20, 30, 31, 40, 41]
    assert sorted(r.doc_id for r in ngram_join.one_per_group(docs).collect()) == [0, 10, 11, 20, 21, 30, 31, 40, 41]


def test_stage_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(test_dedup, "shingles", five_words)
    rows = test_dedup.near_copies(4)
    expected = [i for i, _, component in test_dedup.groups_by_hand(rows, (80, 100)) if i == component]
    found = corpus_pipeline.drop_near_copies(spark, make(spark, [(i, t, "s") for i, t in rows]), "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(expected)

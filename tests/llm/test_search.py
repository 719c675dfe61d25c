"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from fixtures import LONG, awkward, clashing, make, plain

from weirlog.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, top=10):
    """(item_id, rank, doc_id, score) by scoring every document."""
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(doc_id, c) for doc_id, c in counted if c]
    n_docs, n_words = len(counted), sum(c.total() for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    asked = {}
    for item_id, text in items:
        if item_id is not None:
            asked.setdefault(item_id, set()).update(terms(text))
    result = []
    for item_id, own in asked.items():
        scores = []
        for doc_id, c in counted:
            m = 10 + 90 * c.total() * n_docs // n_words
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) for t in own}
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        result += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(result, key=repr)


def found(spark, docs, items, top=10):
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    table = make(spark, [(i, t, "a") for i, t in docs]).repartition(3)
    return plain(lexical_search.search(clashing(table), clashing(asked), top), "item_id", "rank", "doc_id", "score")


def random_docs(n, words, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("block", [37, 100_000])
def test_equals_scores_of_all_documents(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCUMENTS", block)
    monkeypatch.setattr(lexical_search, "FIRST_READ", 4)
    docs = random_docs(700, 80, 1)
    items = [(i, t) for i, t in random_docs(25, 80, 2)] + [(3, "w0 w1"), (None, "w0"), (90, "unheard of"), (91, None), (92, "W0, w0! w79")]
    assert found(spark, docs, items) == by_hand(docs, items)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(41, "other words"), (None, "same words here"), (7, "same words here")]
    items = [(1, "same here"), (2, "words")]
    assert found(spark, docs, items) == by_hand(docs, items)
    assert found(spark, docs, items, 60) == by_hand(docs, items, 60)


def test_several_passes_over_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 100)
    docs, items = random_docs(200, 40, 3), [(i, t) for i, t in random_docs(12, 40, 4)]
    assert found(spark, docs, items) == by_hand(docs, items)


def test_odd_texts(spark):
    docs = [(r.doc_id, r.text) for r in awkward(spark).collect()] + [(50, "x" * 1_000_000), (51, "1" * 1_000_000 + " one")]
    items = [(1, "ONE two — É 漢字 é ²"), (2, LONG), (3, "x" * 1_000_000), (4, "one one 1234 don t"), (5, "")]
    assert found(spark, docs, items) == by_hand(docs, items)


def test_empty_tables(spark):
    docs, items = awkward(spark), spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 1"), items)):
        result = lexical_search.search(d, i)
        assert result.columns == ["item_id", "rank", "doc_id", "score"] and result.count() == 0


def test_reading_stops_before_the_ends_of_the_lists():
    """A term of three documents decides; the long list of a common one is not read through."""
    import numpy as np

    n = 20_000
    numbers = {b"rare": 0, b"common": 1}
    statistics = lexical_search._Statistics(numbers, n, 2 * n, {0: 3, 1: n // 2})
    texts = [np.array([1] * (1 + i % 50) + ([0] if i in (48, 98, 148) else []), np.int32) for i in range(n)]
    block = lexical_search._Block(np.arange(n), texts, np.array([2] * n), statistics)
    ids, scores = block.best(np.array([0, 1]), 3, 0)
    assert sorted(ids[np.argsort(-scores)][:3]) == [48, 98, 148]
    assert 0 < (block.lower > 0).sum() < n / 4

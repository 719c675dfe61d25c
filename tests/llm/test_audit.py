"""The filter audit against applying every order to every document."""

import itertools
import random

import pytest
from fixtures import LONG, awkward, clashing, make, plain, words
from pyspark.sql import functions as F

from weirlog.llm import filter_audit

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def failures(rows):
    """The letters that each (doc_id, text, source) fails."""
    result = []
    for doc_id, text, _ in rows:
        text = text or ""
        own = words(text)
        smaller = any(t == text and i is not None and (doc_id is None or i < doc_id) for i, t in ((r[0], r[1] or "") for r in rows))
        fails = {
            "A": len(own) < 200,
            "B": 100 * len(set(own)) < 50 * len(own),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": smaller,
        }
        result.append({f for f, failed in fails.items() if failed})
    return result


def by_hand(rows, labels):
    failed, result = failures(rows), []
    good, toxic = ({i for i, *marks in labels if i is not None and marks[n] == 1} for n in (0, 1))
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                removed_by[letter] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), sum(letter in d[1] for d in own) - len(gone),
                              sum(d[1] == {letter} for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        result += [(*line, removed_by[line[1][line[2] - 1]]) for line in lines]
    return sorted(result, key=repr)


def some_rows(n=160):
    draw = random.Random(5)
    def text():
        kind = draw.randrange(5)
        many = [f"w{draw.randrange(400)}" for _ in range(draw.choice([3, 150, 199, 200, 260]))]
        if kind == 1:
            many = [draw.choice(["a", "b", "É"]) for _ in many]
        if kind == 2:
            many = [w.upper() for w in many]
        if kind == 3:
            many.append(draw.choice("#$%&*|"))
        return draw.choice([" ", "\n", "\t "]).join(many)
    texts = [text() for _ in range(n // 2)]
    boiler = "the same beginning of many texts, word for word, over and over again " * 12
    texts += [boiler, boiler + "x", boiler + "y", boiler[:600], boiler[:9], "", None]
    rows = [(i, draw.choice(texts), draw.choice(["a", "b", None, ""])) for i in range(n)]
    return rows + [(None, texts[0], "a"), (None, "only without id", "b"), (None, "only without id", "b"), (3, rows[3][1], "c"), (3, rows[3][1], "c"), (3, "else", "c")]


@pytest.mark.parametrize("heavy", [0, 2000, None])
def test_equals_all_orders_applied(spark, heavy):
    rows = some_rows()
    labels = [(i, i % 3 == 0, i % 7 == 0) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1), (3, None, 1)]
    labels = [(i, None if q is None else int(q), int(t)) for i, q, t in labels]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = clashing(make(spark, rows).repartition(3))
    found = filter_audit.audit(docs, clashing(table), heavy_bytes=heavy)
    assert plain(found, *COLUMNS) == by_hand(rows, labels)


def test_small_tries_and_batches(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 1)
    monkeypatch.setattr(filter_audit, "KINDS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = some_rows(60)
        labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
        found = filter_audit.audit(make(spark, rows), labels, (2, 4), 50)
        assert plain(found, *COLUMNS) == by_hand(rows, [])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(6, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in awkward(spark).collect()] + [(60, "x" * 1_000_000, "z"), (61, LONG, "z")]
    assert plain(filter_audit.audit(make(spark, rows), labels), *COLUMNS) == by_hand(rows, [(6, 1, 0)])
    empty = filter_audit.audit(awkward(spark).limit(0), labels)
    assert empty.columns == COLUMNS and empty.count() == 0


def test_a_group_of_copies_leaves_a_batch_once(spark):
    docs = make(spark, [(i, "copied text", "a") for i in range(5000)])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    masks = filter_audit.failure_masks(docs.coalesce(2), labels).orderBy("mask").collect()
    assert [(r.mask, r.n) for r in masks] == [(1, 1), (17, 4999)]
    rows = docs.coalesce(2).select("doc_id", F.col("text").cast("binary").alias("text"), F.lit("a").alias("part"), *(F.lit(False).alias(c) for c in ("quality", "toxic")))
    assert filter_audit._collapsed(rows).count() == 2


def test_trie_finds_what_was_put_in():
    draw = random.Random(9)
    texts = [bytes(draw.choices(b"ab", k=draw.randint(0, 12))) for _ in range(3000)]
    trie, lows = filter_audit.Trie(), {}
    for i, text in enumerate(texts):
        trie.terminal(text).add(("k",), 1, i, 1)
        lows.setdefault(text, i)
    assert {text: node.kinds[("k",)][1] for text, node in trie.texts()} == lows
    assert sum(node.kinds[("k",)][0] for node in trie.terminals()) == len(texts)

"""Line dedup against plain decisions over all lines."""

import hashlib
import re

from fixtures import awkward, clashing, make, plain

from weirlog.llm import line_dedup

SHARED = "This line is found in a good many documents of the corpus."
NEAR = "x" * 39


def key(line):
    text = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def by_hand(rows, least_length=40, least_documents=5):
    """(doc_id, n_lines, n_dropped, kept text) of each row."""
    held = {}
    for doc_id, text in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                held.setdefault(key(line), set()).add(doc_id)
    keep = {k: max(ids) for k, ids in held.items() if len(k) >= least_length and len(ids) >= least_documents}
    result = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if keep.get(key(line), doc_id) == doc_id]
        result.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return result


def digests(rows):
    return sorted([(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows], key=repr)


def some_rows():
    rows = [(i, f"own line {i} of this document, long enough to count\n  {SHARED.upper()}\t\n\n{SHARED}") for i in range(1, 6)]
    rows += [(6, SHARED), (6, f"again\n{SHARED}"), (None, f"{SHARED}\nno id"), (7, None), (8, ""), (9, "\n\n")]
    rows += [(i, f"{NEAR}\n{'É' * 40}\r") for i in range(20, 24)] + [(24, f"{NEAR}\n{'é' * 40}"), (25, "É" * 40)]
    rows += [(i, "\n".join(f"line number {j} of a very long text that many share" for j in range(3000))) for i in range(30, 37)]
    return rows + [(None, SHARED)] * 3 + [(2, rows[1][1])]


def test_lines_equal_plain_decisions(spark):
    rows = some_rows()
    docs = clashing(make(spark, [(i, t, "a") for i, t in rows]))
    found = line_dedup.line_digests(docs)
    assert plain(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == digests(by_hand(rows))
    assert dict(found.dtypes)["n_lines"] == "bigint"


def test_texts_of_the_rows_that_lose_lines(spark):
    rows = some_rows()
    docs = make(spark, [(i, t, "a") for i, t in rows])
    kept = line_dedup.drop_shared_lines(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    expected = [(i, None if text is None else by[3]) for (i, text), by in zip(rows, by_hand(rows))]
    assert plain(kept, "doc_id", "text") == sorted(expected, key=repr)


def test_other_thresholds(spark):
    rows = [(i, f"ab\ncommon\n{i % 3} of three") for i in range(9)]
    found = line_dedup.line_digests(make(spark, [(i, t, "a") for i, t in rows]), 6, 3)
    assert plain(found, *found.columns) == digests(by_hand(rows, 6, 3))


def test_odd_and_empty_tables(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = line_dedup.line_digests(docs, 1, 2)
    assert plain(found, *found.columns) == digests(by_hand(rows, 1, 2))
    assert line_dedup.line_digests(docs.limit(0)).count() == 0
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


def test_one_line_without_end_and_one_of_white_space(spark):
    rows = [(1, "a" * 1_000_000), (2, " " * 1_000_000 + "b"), (3, "\n" * 200_000)]
    found = line_dedup.line_digests(make(spark, [(i, t, "a") for i, t in rows]))
    assert plain(found, *found.columns) == digests(by_hand(rows))


def test_counting_spreads_a_hot_line(spark):
    """Documents are counted per hash from rows dealt out by hash and document together."""
    docs = make(spark, [(i, SHARED, "a") for i in range(50)])
    plan = line_dedup.shared_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [hash" in plan and "doc_id" in plan and "Python" not in plan

import duckdb
import pytest
from fixtures import awkward, clashing, make, plain, words
from pyspark.sql import functions as F

from weirlog.llm import mixing


def targets_by_hand(sizes):
    """Reshare what capped sources cannot give until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    cap = {s: 2 * sizes[s] for s in names}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(cap[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        level = left / free if free else 0
        over = {s for s in names if s not in capped and weight[s] * level > cap[s]}
        if not over:
            return {s: cap[s] if s in capped else weight[s] * level for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 30, None: 5}, {"x": 7}, {"a": 0, "b": 0}, {"a": 100, "b": 1, "c": 0, "d": 50, "e": 60}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id bigint, source string, size bigint")
    found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert found == pytest.approx(targets_by_hand(sizes))


def some_docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 900)), f"s{i % 7}" if i % 3 else "hot") for i in range(400)]
    return make(spark, rows + [(400, None, "s1"), (401, "", None), (402, "one two", None)])


def test_every_source_comes_to_its_target(spark):
    docs = some_docs(spark)
    rows = mixing.taken_words(clashing(docs)).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by_source = {}
    sources = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        taken, target = by_source.get(sources[r.doc_id], (0, 0.0))
        by_source[sources[r.doc_id]] = (taken + r.taken, r.target)
    assert all(abs(taken - target) <= 1 for taken, target in by_source.values())
    again = mixing.taken_words(docs.repartition(3, "source"))
    assert plain(again, *again.columns) == sorted(map(tuple, rows), key=repr)


def test_the_schedule_follows_the_weights_everywhere(spark):
    sizes = [(0, "a", 400_000), (1, "b", 300_000), (2, "c", 900_000)]
    rows = spark.createDataFrame(sizes, "doc_id bigint, source string, size bigint")
    slots = mixing.schedule(mixing.source_targets(rows), 512).orderBy("slot").collect()
    ranks = {}
    total = {s: sum(r.source == s for r in slots) for s in "abc"}
    for n, r in enumerate(slots, 1):
        assert r["rank"] == ranks.get(r.source, 0)
        ranks[r.source] = r["rank"] + 1
        assert all(abs(ranks.get(s, 0) - n * total[s] / len(slots)) < 5 for s in "abc")


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = mixing.taken_words(clashing(docs))
    assert plain(found, "doc_id", "size") == sorted(((r.doc_id, len(words(r.text))) for r in docs.collect()), key=repr)
    assert mixing.taken_words(make(spark, [])).count() == 0
    assert mixing.mixed_documents(make(spark, [])).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    docs = some_docs(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r.n for r in mixing.word_counts(mixed).groupBy("doc_id").agg(F.sum("size").alias("n")).collect()}
    assert got == {r.doc_id: r.taken for r in mixing.taken_words(docs).collect() if r.taken}
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text in whole[r.doc_id] for r in mixed.collect())


def test_points_are_fractions_of_golden_multiples(spark):
    from decimal import Decimal

    for slot in (0, 1, 65_535, 65_536, 10**11 + 7):
        exact = float((Decimal(slot) + Decimal("0.5")) * Decimal(mixing.GOLDEN) % 1)
        found = spark.range(1).select(mixing._point(F.lit(slot).cast("bigint"))).first()[0]
        assert found == pytest.approx(exact, abs=1e-8)


def test_duckdb_agrees_on_the_sample(spark):
    from weirlog.llm.queries import SQL, op10_mixing

    folder = "/root/testdata/sf0.001"
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    theirs = database.sql(SQL["op10_mixing"]).df()[["doc_id", "size", "source_size", "target", "taken"]]
    ours = op10_mixing(spark, folder)
    assert plain(ours, *theirs.columns) == sorted((tuple(x.item() for x in row) for row in theirs.to_records(index=False)), key=repr)


def test_every_stretch_of_the_output_follows_the_weights(spark):
    """The slots that documents are taken in, as the operator returns them, and not the schedule alone."""
    rows = mixing.mix(some_docs(spark), block_words=64).where("n > 0").select("slot", "source").distinct().collect()
    last = max(r.slot for r in rows)  # the few late ones share a slot of their own at the end
    of_slot = {r.slot: r.source for r in rows if r.slot < last}
    total = {s: sum(x == s for x in of_slot.values()) for s in set(of_slot.values())}
    slots = sorted(of_slot)
    for start in range(0, len(slots) - 200, 50):
        part = [of_slot[s] for s in slots[start : start + 200]]
        assert all(abs(part.count(s) - 200 * total[s] / len(slots)) < 8 for s in total), start


def test_first_slots_and_their_number(spark):
    docs = some_docs(spark)
    mixed = mixing.mix(docs).where("n > 0").groupBy("doc_id").agg(F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    found = mixing.taken_words(docs)
    assert plain(found.where("n_slots > 0"), "doc_id", "first_slot", "n_slots") == plain(mixed, "doc_id", "first_slot", "n_slots")
    assert found.where("taken = 0").where("first_slot IS NOT NULL OR n_slots > 0").count() == 0

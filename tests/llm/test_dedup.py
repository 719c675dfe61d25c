import hashlib
import random
from collections import defaultdict

import pytest
from fixtures import awkward, clashing, make, plain, words
from pyspark.sql import functions as F

from weirlog.llm import components, exact_dedup, ngram_join

EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    result = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        result.append((doc_id, keep, len(ids), doc_id == keep, digest))
    return sorted(result, key=repr)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("digest", [exact_dedup.md5_bytes, lambda text: F.unhex(F.lit("00")), lambda text: F.unhex(F.substring(F.md5(text.cast("binary")), 1, 2))])
def test_exact_groups(spark, digest):
    docs = awkward(spark)
    found = exact_dedup.exact_groups(clashing(docs), digest=digest)
    assert plain(found, *EXACT) == exact_by_hand(pairs_of(docs))


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(make(spark, [])).count() == 0


def test_a_hot_group(spark):
    rows = [(i, "same text everywhere" if i % 3 else f"text {i}", "a") for i in range(600)]
    found = exact_dedup.exact_groups(make(spark, rows).repartition(8))
    assert plain(found, *EXACT) == exact_by_hand([(i, t) for i, t, _ in rows])


def test_drop_copies_keeps_all_columns(spark):
    docs = clashing(awkward(spark))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 6, 6, 7, 8, 9]


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)])


def groups_by_hand(rows, share=(90, 100)):
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and share[1] * common >= share[0] * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((i, len(sets[i]), find(i)) for i in ids), key=repr)


def near_copies(seed):
    """Families of edited copies, a passage that many share, chains, and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, rows = text(60), []
    for size, members, edits in ((120, 40, 2), (60, 12, 1), (300, 6, 9), (30, 8, 1)):
        base = text(size)
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    chain = text(200)
    for _ in range(15):
        chain = list(chain)
        chain[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append(chain)
    rows += [text(rng.randint(5, 40)) + passage + text(rng.randint(5, 40)) for _ in range(40)]
    rows += [text(rng.randint(1, 4)) for _ in range(20)] + [["a", "b"], ["a", "b"], ["a"], ["A"]]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_groups_equal_all_pairs(spark, seed):
    rows = near_copies(seed)
    docs = make(spark, [(i, t, "a") for i, t in rows]).repartition(5)
    found = plain(ngram_join.similar_groups(docs), "doc_id", "n_shingles", "component_id")
    assert found == groups_by_hand(rows)


def test_similar_groups_of_awkward_rows(spark):
    found = plain(ngram_join.similar_groups(clashing(awkward(spark))), "doc_id", "n_shingles", "component_id")
    long = len(shingles(next(t for i, t in pairs_of(awkward(spark)) if i == 4)))
    assert found == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, long, 4), (5, 3, 5), (6, 3, 5), (6, 3, 5), (7, 3, 5), (9, 2, 9)]
        + [(8, len(shingles("É ⅷ 漢字 😀 ² _x 'S don't   end")), 8), (None, 1, None), (None, 3, 5)],
        key=repr,
    )
    assert ngram_join.similar_groups(make(spark, [])).count() == 0


def test_prefixes_of_linked_sets_meet_under_every_order():
    import numpy as np

    rng = np.random.default_rng(5)
    ranks = rng.integers(0, 40, 1 << ngram_join.LEAST_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.04], rng.integers(0, 2**63, int(n * 0.03)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= 90 * (len(a) + len(b) - common):
            for order in range(3):
                own = ranks if order == 0 else None
                assert len(np.intersect1d(*(ngram_join._prefix(s, own, order, (90, 100)) for s in (a, b))))


def test_counters_follow_the_tokens(spark, monkeypatch):
    """Common tokens rank above rare ones, all documents are counted, and more text makes more counters."""
    import numpy as np

    rows = [(i, f"passage shared by many documents of this corpus w{i} x{i} y{i}") for i in range(300)]
    docs = make(spark, [(i, t, "a") for i, t in rows]).repartition(4)
    monkeypatch.setattr(ngram_join, "LEAST_BITS", 14)
    ranks = ngram_join.token_ranks(docs, 3)
    assert len(ranks) == 1 << 14
    monkeypatch.setattr(ngram_join, "LOAD", 1)
    monkeypatch.setattr(ngram_join, "TOKEN_BYTES", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_BITS", 10)
    monkeypatch.setattr(ngram_join, "LEAST_BITS", 11)
    ranks = ngram_join.token_ranks(docs, 3)
    bits = len(ranks).bit_length() - 1
    assert bits == 15  # of some 16,500 bytes
    counts = np.zeros(len(ranks))
    for _, text in rows:
        for token in ngram_join.tokens_of(text.encode(), 3):
            counts[int(token) >> (64 - bits)] += 1
    assert (ranks == np.minimum(np.rint(8 * np.log2(counts + 1)), 255)).all()
    assert ranks.max() == 66 and len(ngram_join.token_ranks(make(spark, []), 3)) == 1 << 11


def test_families_that_share_half_their_text_make_few_pairs(spark, monkeypatch):
    """200 families of 10 documents with a passage in common, and in each two near copies."""
    rng = random.Random(8)
    rows = []
    for family in range(200):
        passage = [f"f{family}w{i}" for i in range(40)]
        own = [[f"d{family}x{k}y{i}" for i in range(40)] for k in range(9)]
        texts = [passage + o if rng.random() < 0.5 else o + passage for o in own]
        texts.append(texts[0][:-1] + ["changed"])
        rows += [(10 * family + k, " ".join(t)) for k, t in enumerate(texts)]
    made = []
    original = ngram_join._cross_pairs

    def counted(*args):
        made.append(original(*args).count())
        return original(*args)

    monkeypatch.setattr(ngram_join, "_cross_pairs", counted)
    found = ngram_join.similar_groups(make(spark, [(i, t, "a") for i, t in rows]), 5, 80, 100)
    groups = {r.doc_id: r.component_id for r in found.collect()}
    assert groups == {i: i - 9 if i % 10 == 9 else i for i, _ in rows}
    assert made[0] < 500  # all pairs within families would be 9,000


@pytest.mark.parametrize("fruit", [0, 10**9])
def test_star_rounds_change_nothing(spark, monkeypatch, fruit):
    """Nodes tried first, once or as long as anything comes of it, leave the same groups."""
    monkeypatch.setattr(ngram_join, "MOST_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "LEAST_FRUIT", fruit)
    monkeypatch.setattr(ngram_join, "BANDS", 1)
    monkeypatch.setattr(ngram_join, "BAND_HASHES", 6)
    rows = near_copies(4)
    found = ngram_join.similar_groups(make(spark, [(i, t, "a") for i, t in rows]))
    assert plain(found, "doc_id", "n_shingles", "component_id") == groups_by_hand(rows)


def test_star_pairs_grow_with_the_nodes(spark):
    """Of a large group of near copies a node outside meets a few inside, however many of their tokens it shares."""
    rows = [(token, node, 40, 0 if node < 100 else node, token, 0) for node in range(300) for token in range(30)]
    rows = spark.createDataFrame(rows, "token long, node long, n long, component long, at int, main long")
    first = ngram_join._star_pairs(rows, (80, 100)).collect()
    assert len(first) <= 4 * 200 and {r.b for r in first} == set(range(100, 300)) and all(r.a < 100 for r in first)


def edited_copies():
    """400 copies of 146 words with up to five words changed each: many are not similar to most others."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(146)]
    rows = []
    for k in range(400):
        copy = list(base)
        for place in rng.sample(range(146), rng.randrange(6)):
            copy[place] = f"e{rng.randrange(300)}"
        rows.append((k, " ".join(copy)))
    return rows


def five_words(text):
    w = words((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_copies_outside_a_group_meet_few_of_its_members(spark, monkeypatch):
    """Whole sets are compared for some pairs a document, not for members times those outside."""
    monkeypatch.setitem(globals(), "shingles", five_words)
    rows, made = edited_copies(), []
    original = ngram_join._verified

    def counted(pairs, *args):
        made.append(pairs.count())
        return original(pairs, *args)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    found = ngram_join.similar_groups(make(spark, [(i, t, "a") for i, t in rows]), 5, 80, 100)
    assert [(i, c) for i, _, c in sorted(plain(found, "doc_id", "n_shingles", "component_id"))] == [(i, c) for i, _, c in sorted(groups_by_hand(rows, (80, 100)))]
    assert sum(made) <= 8 * len(rows)


def test_differences_find_all_links(spark, monkeypatch):
    """Whatever the center: of ids that repeat with other texts, with none, far from the group; each node in one bin."""
    monkeypatch.setattr(ngram_join, "MOST_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "LEAST_FRUIT", 0)
    monkeypatch.setattr(ngram_join, "BANDS", 1)
    monkeypatch.setattr(ngram_join, "BAND_HASHES", 8)
    rows = near_copies(7)
    groups = {i: c for i, _, c in groups_by_hand(rows)}
    again = [(c, None) for c in set(groups.values())][:40]  # an empty text beside that of a center
    found = ngram_join.similar_groups(make(spark, [(i, t, "a") for i, t in rows + again]))
    assert {r.doc_id: r.component_id for r in found.where("n_shingles > 0").collect()} == groups


def test_one_per_group_keeps_all_columns(spark):
    docs = clashing(awkward(spark))
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 8, 9]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    links += [(500, i) for i in range(501, 600)] + [(700, 700)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    linked = {i for a, b in links if a != b for i in (a, b)}
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert plain(found, "node", "component") == sorted(((i, find(i)) for i in linked), key=repr)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

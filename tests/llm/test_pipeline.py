"""The pipeline against the same decisions taken one after the other on plain Python rows."""

import hashlib
import random
import zlib

import public_tokenizers
from fixtures import awkward, make, plain, words
import test_dedup
from pyspark.sql import functions as F
from test_dedup import groups_by_hand, near_copies
from test_mixing import targets_by_hand
from test_pipeline_near import five_words

import corpus_pipeline
from weirlog.llm import bpe


def corpus():
    rng = random.Random(9)
    rows = [(i, text, f"s{rng.randrange(4)}", "en") for i, text in near_copies(4)]
    rows += [(1000 + i, rows[i][1], "hot", "en") for i in range(0, 60, 2)]
    return rows + [(2000, None, "s1", None), (2001, "1234 --", "s1", None), (2002, "é solo", None, "es")]


def mixed_by_hand(rows):
    """(doc_id, text) of the mix: sources' words in hashed order, taken round after round up to the target."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    targets, result = targets_by_hand(sizes), []
    for source in sizes:
        left = int(targets[source] + 0.5)
        inside = [(hashlib.md5(f"mix{i}".encode()).hexdigest(), len(words(t)), i, t) for i, t, s in rows if s == source]
        while left > 0:
            for _, size, doc_id, text in sorted(inside):
                n = min(size, left)
                left -= n
                if n == size and n:
                    result.append((doc_id, text))
                elif n:
                    parts, cut = words(text)[:n], 0
                    for word in parts:
                        cut = text.index(word, cut) + len(word)
                    end = cut
                    while end < len(text) and text[end] in " \t\n\r\x0b\x0c":
                        end += 1
                    result.append((doc_id, text.lstrip(" \t\n\r\x0b\x0c")[: end - (len(text) - len(text.lstrip(" \t\n\r\x0b\x0c")))]))
    return result


def test_pipeline_equals_plain_decisions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(test_dedup, "shingles", five_words)
    rows = corpus()
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    import tiktoken

    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.RANKS), special_tokens={})
    kept = [(i, t, s) for i, t, s, _ in rows if t and any(map(str.isalpha, t))]
    largest = {}
    for i, t, _ in kept:
        largest[t] = max(largest.get(t, i), i)
    kept = [r for r in kept if largest[r[1]] == r[0]]
    component = {i: c for i, _, c in groups_by_hand([(i, t) for i, t, _ in kept], (80, 100))}
    kept = [r for r in kept if component[r[0]] == r[0]]
    expected = []
    for doc_id, text in mixed_by_hand(kept):
        ids = codec.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        expected.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert plain(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_language_stage_loses_no_document_with_a_letter(spark):
    """Whatever the labels are called, and without any; documents without a label get one."""
    rows = [(i, text, "s", lang) for i, (text, lang) in enumerate([("the cat sat on the mat and that was it", "en"), ("le chat est sur la table avec les autres", "fr")] * 6)]
    rows += [(90, "the cat and the mat", "s", None), (91, "1234 --", "s", "en"), (92, None, "s", "en"), (93, "é", "s", None)]
    lettered = [r[0] for r in rows if r[0] not in (91, 92)]

    def stage(labels):
        docs = make(spark, [(i, t, s, labels.get(lang, lang)) for i, t, s, lang in rows])
        found = corpus_pipeline.identify_language(spark, docs, "")
        assert found.columns == docs.columns
        return {r.doc_id: r.lang for r in found.collect()}

    found = stage({})
    assert sorted(found) == lettered and found[90] == "en" and found[0] == "en" and found[1] == "fr"
    assert sorted(stage({"en": "und"})) == lettered and stage({"en": "und"})[90] == "und"
    none = stage({"en": None, "fr": None})
    assert sorted(none) == lettered and set(none.values()) == {None}


def test_stages_keep_the_columns(spark, tmp_path):
    docs = awkward(spark).withColumn("size", F.col("doc_id"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_pipeline_of_nothing(spark, tmp_path):
    make(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_goes_by_the_identified_languages(spark):
    """Labels are missing or wrong for some; of each language the mix takes one and a half times its words all the same."""
    say = {"en": "the cat sat on the mat with that thing and", "fr": "les chats dormaient sur une table avec leurs frères et"}
    true = {i: "fr" if i % 4 == 0 else "en" for i in range(48)}
    rows = [(i, f"{say[lang]} {'abcdefgh'[i % 8]}{'xyzuvw'[i // 8]}", "s", lang) for i, lang in true.items()]
    unseen = {i for i in true if zlib.crc32(str(i).encode()) % 4 == 2}  # nothing is learned from these
    rows = [(i, text, s, (None if i % 3 else "en") if i in unseen else lang) for i, text, s, lang in rows]
    assert any(lang == "en" != true[i] for i, _, _, lang in rows)
    docs = corpus_pipeline.identify_language(spark, make(spark, rows), "")
    assert {r.doc_id: r.lang for r in docs.collect()} == true
    taken = {"en": 0, "fr": 0}
    for row in corpus_pipeline.mix_sources(spark, docs, "").collect():
        taken[row.lang] += len(words(row.text))
    sizes = {lang: sum(len(words(text)) for i, text, _, _ in rows if true[i] == lang) for lang in taken}
    assert taken == {lang: 1.5 * size for lang, size in sizes.items()}

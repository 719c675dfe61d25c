"""Scans, language, tokens: every operator that looks at one text at a time."""

import hashlib
import math
import random
import re
import time
import zlib

import public_tokenizers
import pytest
from fixtures import LONG, awkward, clashing, make, plain

from weirlog.llm import bpe, language, licenses, secrets, token_counts
from weirlog.llm.license_templates import PHRASES, TEMPLATES

SAMPLE = "/root/testdata/sf0.01"


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# Licences


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def licence_base(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = []
    for label, phrase in PHRASES:
        wanted = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i : i + len(wanted)] == wanted]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(found), len(places), min(starts, default=None), max(starts, default=None), labels


@pytest.mark.parametrize("table", ["awkward", "sample"])
def test_licence_base_equals_word_by_word_search(spark, table):
    docs = clashing(awkward(spark)) if table == "awkward" else spark.read.parquet(f"{SAMPLE}/documents.parquet")
    found = plain(licenses.scan_licenses(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == sorted(((i, *licence_base(t)) for i, t in texts_of(docs)), key=repr)


def scanned(text):
    automaton = licenses.Automaton((*PHRASES, *TEMPLATES))
    return licenses.scan(licenses.words_of(text.encode()), automaton, len(PHRASES))


def test_templates_match_their_own_wording_and_nothing_less():
    for label, markup in TEMPLATES:
        automaton = licenses.Automaton([(label, markup)])
        full = re.sub(r"<<any:(\d+)>>", lambda m: "filler " * min(2, int(m[1])), markup)
        for text in (re.sub(r"<<optional>>|<<end>>", " ", full), re.sub(r"<<optional>>.*?<<end>>", " ", full, flags=re.DOTALL)):
            words = licenses.words_of(text.encode())
            assert (0, 0, len(words)) in list(automaton.matches([*words, b"after"])), label
            for gone in range(len(words)):
                fewer = words[:gone] + [b"zzz"] + words[gone + 1 :]
                if words[gone] != b"filler":
                    assert all(end - start < len(words) for _, start, end in automaton.matches(fewer)), (label, words[gone])


def test_labels_regions_and_score():
    row = scanned("x MIT License, and: licensed under the Apache License Version 2.0 GNU General Public License, version 3 mit license")
    assert row["base_labels"] == "apache,gpl,mit" and row["labels"] == "apache,apache-2.0,gpl,gpl-3.0,mit"
    assert (row["n_base"], row["first_word"], row["last_word"]) == (4, 1, 18) and 0 < row["score"] <= 1
    assert scanned("")["score"] == 0.0 and scanned("the license of mit")["labels"] == ""


def test_automaton_takes_at_most_the_named_number_of_words():
    automaton = licenses.Automaton([("x", "begin <<any:2>> end<<optional>> now <<optional>>or later<<end>><<end>>")])
    ends = lambda text: [(s, e) for _, s, e in automaton.matches(text.encode().split())]
    assert ends("begin end") == [(0, 2)] and ends("begin a b end now or later") == [(0, 7)]
    assert ends("begin a b c end") == [] and ends("begin begin end now or") == [(0, 4), (1, 4)]
    with pytest.raises(ValueError):
        licenses.Automaton([("x", "<<any:1>> word")])


# Secrets

ASSIGN = re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def secret_base(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def test_secrets_of_random_texts():
    rng = random.Random(4)
    parts = ["token", "TOKEN=", "api_key", "ApiKey", " ", '"', "'", ":", "= ", "abc", "é", "ſecret", "AKIA", "ABCD1234", "AKIAAKIA", "0123456789abcdef", "\n", "key.x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        spans = secrets._joined(list(secrets.base_spans(text)))
        assert spans == secret_base(text), text


@pytest.mark.parametrize("table", ["awkward", "sample"])
def test_secret_base_equals_the_patterns(spark, table):
    docs = clashing(awkward(spark)) if table == "awkward" else spark.read.parquet(f"{SAMPLE}/documents.parquet")
    found = plain(secrets.scan_secrets(docs), "doc_id", "base_sha256")
    assert found == sorted(((i, hashlib.sha256(secret_base(t).encode()).hexdigest()) for i, t in texts_of(docs)), key=repr)


def test_incremental_entropy_equals_direct_counts():
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice("abcdef0123") for _ in range(rng.randint(1, 70)))
        direct = []
        for i in range(len(text) - 19):
            window = text[i : i + 20]
            shares = [window.count(c) / 20 for c in set(window)]
            direct.append(-sum(p * math.log2(p) for p in shares))
        assert list(secrets.window_entropies(text)) == pytest.approx(direct)


@pytest.mark.parametrize(
    "candidate, suspect",
    [
        ("Zk3vQ9xT7mB2cR8wL5yH1n", True),
        ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", True),
        ("123e4567-e89b-12d3-a456-426614174000", False),
        ("12345678901234567890123", False),
        ("aaaaaaaaaaaaaaaaaaaaaaaaaaaa", False),
        ("einheitverberbeeinheitkeiter", False),
        ("some_long_identifier_of_words", False),
        ("Zk3vQ9xT7mEXAMPLEB2cR8wL5y", False),
    ],
)
def test_entropy_and_allow_list(candidate, suspect):
    assert bool(list(secrets.entropy_spans(f"see {candidate} here"))) is suspect


# Language


def test_suffix_automaton_holds_exactly_the_substrings():
    text = [1, 2, 1, 3, 1, 2, 2, 1]
    automaton = language.SuffixAutomaton(text)

    def holds(part):
        state = 0
        for symbol in part:
            if symbol not in automaton.next[state]:
                return False
            state = automaton.next[state][symbol]
        return True

    inside = {tuple(text[i:j]) for i in range(8) for j in range(i + 1, 9)}
    import itertools

    for n in range(1, 5):
        for part in itertools.product((1, 2, 3), repeat=n):
            assert holds(part) == (part in inside)


def phrases_by_hand(sample, text):
    """Greedy longest matches inside blocks."""
    count = 0
    for start in range(0, len(text), language.BLOCK):
        block, i = text[start : start + language.BLOCK], 0
        while i < len(block):
            n = 1
            while i + n <= len(block) and block[i : i + n] in sample:
                n += 1
            i += max(1, n - 1)
            count += 1
    return count


def test_phrases_equal_greedy_longest_matches():
    rng = random.Random(2)
    samples = {lang: "".join(rng.choice(letters) for _ in range(400)) for lang, letters in (("x", "abc "), ("y", "bcdé "))}
    model = language.Model(samples)
    texts = ["", "a", "q", "abcabcd bbq" * 7, "".join(rng.choice("abcdé q") for _ in range(1500))]
    texts += ["".join(rng.choice("abc") for _ in range(rng.randint(1, 700))) for _ in range(30)]
    symbols = [model.symbols(t) for t in texts]
    as_text = lambda s: "".join(map(chr, s))
    known = [as_text(model.symbols(samples[lang])) for lang in model.languages]
    expected = [[phrases_by_hand(k, as_text(s)) for k in known] for s in symbols]
    assert model.phrases(symbols).tolist() == expected


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    given = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs, language.learn(docs)).collect()
    assert len(rows) == len(given)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es"} for r in rows)
    held_out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == given[r.doc_id] for r in held_out) / len(held_out) > 0.97


def test_language_of_awkward_rows(spark):
    docs = clashing(awkward(spark))
    rows = language.identify(docs, language.learn(docs)).collect()
    unknown = sorted(r.doc_id for r in rows if r.lang_pred == "und")
    assert unknown == [1, 2, 3, 9] and all(r.score == 0 for r in rows if r.lang_pred == "und")
    kept = language.drop_unidentified(docs, language.learn(docs))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert {r.lang_pred for r in language.identify(docs, language.learn(make(spark, []))).collect()} == {"und"}
    assert language.identify(make(spark, []), language.learn(docs)).count() == 0


# Tokens

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tiktoken_codec():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(tiktoken_codec):
    rng = random.Random(3)
    alphabet = "aab  \n\t'sdllé漢字😀0１²Ⅷ__--==\x1c\x85  　Σß"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["", "a" * 20_000, " " * 30_000, "-=" * 5_000, "\x00\x00a", "<|endoftext|>", LONG[:50_000]]
    texts.append("".join(rng.choice("abcdefghijklmnop") for _ in range(1_500)))
    for text, (ids, decoded) in zip(texts, bpe.Codec.of(RANKS, PATTERN).encode(texts)):
        assert ids.tolist() == tiktoken_codec.encode_ordinary(text), text[:80]
        assert decoded == text.encode()


def test_bpe_of_long_words(tiktoken_codec):
    """Runs of letters, digits, one character or a pair of them, without a blank: right, and in seconds."""
    codec = bpe.Codec(RANKS, PATTERN)
    draw = random.Random(3)
    common = "the of and to in that is was for with tion ing ment able".split()
    texts = [
        "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)),
        "a" * 1_000_000,
        "ab" * 200_000,
        "".join(draw.choices("0123456789", k=100_000)),
        "".join(draw.choices(common, k=20_000)),
        "".join(draw.choices("éàüñçøжяшд漢字語", k=20_000)),
        "!?" * 100_000,
    ]
    for text in texts:
        start = time.perf_counter()
        ids, said = codec.encode([text])[0]
        assert time.perf_counter() - start < 30
        assert said == text.encode() and list(ids) == tiktoken_codec.encode_ordinary(text)
    assert codec.encode(["x" * 100 + " y"])[0][1] == b"x" * 100 + b" y"


def test_bpe_forgets_and_learns_again(tiktoken_codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    codec = bpe.Codec(RANKS, PATTERN)
    for text in ("unbelievable things happen", "quite unbelievable", "zyxwv things"):
        assert codec.encode([text])[0][0].tolist() == tiktoken_codec.encode_ordinary(text)


def test_bpe_asks_nothing_about_known_words():
    """Texts of words that the worker knows are put together without the database."""
    codec = bpe.Codec(RANKS, PATTERN)
    texts = ["unhappily undone, ünhäppily", "", "undone unhappily 12345"]
    first = codec.encode(texts)
    codec.database = None
    for (ids, said), (again, same), text in zip(first, codec.encode(texts), texts):
        assert ids.tolist() == again.tolist() and said == same == text.encode()


@pytest.mark.parametrize("table", ["awkward", "sample"])
def test_bpe_digests(spark, tiktoken_codec, table):
    docs = clashing(awkward(spark)) if table == "awkward" else spark.read.parquet(f"{SAMPLE}/documents.parquet")
    expected = []
    for doc_id, text in texts_of(docs):
        ids = tiktoken_codec.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        expected.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = plain(bpe.encode_digests(docs, RANKS, PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(expected, key=repr)


def test_bpe_round_trip(spark):
    docs = awkward(spark)
    found = bpe.encode(docs, RANKS, PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in found if r.doc_id) == sorted((i, t) for i, t in texts_of(docs) if i)
    assert bpe.encode(make(spark, []), RANKS, PATTERN).count() == 0


WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("table", ["awkward", "sample"])
def test_token_counts_equal_the_library(spark, table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    docs = clashing(awkward(spark)) if table == "awkward" else spark.read.parquet(f"{SAMPLE}/documents.parquet")
    expected = []
    for doc_id, text in texts_of(docs):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        expected.append((doc_id, len(text.encode()), n, n > 2048))
    assert plain(token_counts.count_tokens(docs, WORDS), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=repr)
    assert token_counts.count_tokens(make(spark, []), WORDS).count() == 0


def test_token_counts_of_odd_characters():
    from tokenizers import Tokenizer

    tokenizer, lengths = Tokenizer.from_file(WORDS), token_counts.Lengths.of(WORDS)
    rng = random.Random(1)
    alphabet = "abcdeéßÀĲʼnǅŁ 's't \t\n\r\xa0²³½ªº0123<|>|--İſ´¨¯ÆĐĦıŒŦ"
    texts = ["a" + chr(c) + "b " + chr(c) for c in range(9, 0x250)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "Σ", "é", "　"]) for _ in range(1000)]
    assert lengths.counts(texts, {}) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]

"""Labels with next to no text, and many languages in several scripts."""

import random
from collections import Counter

import numpy as np
import pytest
from test_texts import SAMPLE

from weirlog.llm import language


@pytest.fixture(scope="module")
def texts():
    import pyarrow.dataset

    rows = pyarrow.dataset.dataset(f"{SAMPLE}/documents.parquet").to_table(columns=["lang", "text"]).to_pylist()
    return [(r["lang"], r["text"]) for r in rows if r["lang"] and r["text"]]


@pytest.mark.parametrize("word", ["a", "no", "oui", "hola"])
def test_a_label_of_one_word_wins_nothing(texts, word):
    samples = {}
    for lang, text in texts[:400]:
        samples[lang] = (samples.get(lang, "") + "\n" + text)[: language.SAMPLE_CHARS]
    model = language.Model({**samples, "aa": "\n" + word})
    found = Counter(lang for lang, _ in model.predict([text[:400] for _, text in texts[400:550]]))
    assert found["aa"] <= 1, found


def test_ten_languages_in_several_scripts_keep_their_samples():
    rng = random.Random(3)
    starts = [0x61, 0x61, 0x61, 0x3B1, 0x430, 0x430, 0x5D0, 0x905, 0x4E00, 0xAC00]
    vocabularies = []
    for k, start in enumerate(starts):
        size = 600 if start in (0x4E00, 0xAC00) else 22
        letters = [chr(start + i) for i in range(size) if chr(start + i).isalpha()]
        vocabularies.append(["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(1500)])
    samples = {f"l{k}": " ".join(rng.choices(v, k=4000))[: language.SAMPLE_CHARS] for k, v in enumerate(vocabularies)}
    model = language.Model(samples)
    for lang, bits in zip(model.languages, model.bits):
        symbols = model.symbols(samples[lang])
        assert len(symbols) == len(samples[lang]) and bits == pytest.approx(np.log2(len(symbols) + 1))
        assert not (symbols == 1).any()
    texts = [(f"l{k}", " ".join(rng.choices(v, k=8))) for k, v in enumerate(vocabularies) for _ in range(30)]
    right = [lang == found for (lang, _), (found, _) in zip(texts, model.predict([t for _, t in texts]))]
    assert sum(right) >= 0.98 * len(right)
    assert len(model.table) * 4 < 300e6

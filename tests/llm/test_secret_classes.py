"""Found shares of random secrets, bare and behind names, and what stays allowed."""

import random
import re
import string
import time

import pytest

from weirlog.llm import secrets

ALPHABETS = {
    "hex": "0123456789abcdef",
    "letters": string.ascii_lowercase,
    "base36": string.ascii_lowercase + string.digits,
    "base32": string.ascii_uppercase + "234567",
    "base64": string.ascii_letters + string.digits + "+/",
}
#: Least share found of secrets with 20 and with 32 characters.
LEAST = {"hex": (0.94, 0.98), "letters": (0.8, 0.96), "base36": (0.97, 0.99), "base32": (0.95, 0.98), "base64": (0.92, 0.98)}


@pytest.mark.parametrize("name", ["", "key-", "session_key=", "sample/"])
@pytest.mark.parametrize("kind", ALPHABETS)
def test_found_share(kind, name):
    rng = random.Random(5)
    for size, least in zip((20, 32), LEAST[kind]):
        found = 0
        for _ in range(500):
            text = f"see {name}{''.join(rng.choices(ALPHABETS[kind], k=size))} here"
            found += any(end > 4 + len(name) + size // 2 for _, end, _ in secrets.entropy_spans(text))
        assert found >= least * 500, (size, found)


@pytest.mark.parametrize(
    "text",
    [
        "id=123e4567-e89b-12d3-a456-426614174000",
        "request-123e4567-e89b-12d3-a456-426614174000",
        "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
        "src/main/scala/org/apache/spark/sql",
        "number=12345678901234567890123",
        "internationalization_of_names",
    ],
)
def test_known_shapes_stay_allowed(text):
    assert not list(secrets.entropy_spans(f"see {text} here"))


def test_only_the_part_with_the_word_is_allowed():
    secret = "Zk3vQ9xT7mB2cR8wL5yH1n"
    assert list(secrets.entropy_spans(f"example={secret}")) == [(8, 30, "entropy")]
    assert not list(secrets.entropy_spans(f"key={secret}example"))


def test_allowed_parts_equal_their_patterns():
    """What is cut out is what one pattern for all parts covers."""
    together = re.compile(
        r"""(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])
        | wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY | [A-Za-z0-9]*(?i:example|sample|dummy|placeholder)[A-Za-z0-9]* | =""",
        re.VERBOSE,
    )
    rng = random.Random(6)
    pieces = ["example", "EXAMPLE", "sample", "dummy", "x9", "abc", "-", "_", "/", "=", "+", "123e4567-e89b-12d3-a456-426614174000", "0123456789"]
    pieces += ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "placeholder"]
    for _ in range(5000):
        candidate = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        covered = set().union(*(range(*m.span()) for m in together.finditer(candidate)), ())
        assert set().union(*(range(*span) for span in secrets.allowed_parts(candidate)), ()) == covered, candidate


def test_long_runs_take_seconds():
    rng = random.Random(2)
    texts = ["".join(rng.choices(chars, k=1_000_000)) for chars in ("abcdefghijklmnopqrstuvwxyz", "0123456789", "a", "ABCabc0123+/")]
    texts += ["example" * 140_000, "token=" * 170_000, "sample-" * 140_000]
    for text in texts:
        start = time.perf_counter()
        found = secrets.scan(text)
        assert time.perf_counter() - start < 15
        assert found["n_entropy"] >= 0
    assert secrets.scan(texts[1])["n_hex"] == 1 and secrets.scan(texts[2])["n_hex"] == 1 and secrets.scan(texts[0])["n_entropy"] > 0

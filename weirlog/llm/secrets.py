"""Secret scans: fixed patterns, and windows of high entropy for their class of characters in candidate strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: What every match of ``_ASSIGN`` contains in lower case; spares most texts the pattern.
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_LEAST, _ACCESS_LEAST, _HEX_LEAST = 8, 16, 32
# A match takes the whole run, so asking for the least length at once finds the same.
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{_ACCESS_LEAST - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{_HEX_LEAST},}}")

#: Characters in a window.
WINDOW = 20
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Kinds of characters, one bit each; a window's class follows from the kinds that it holds.
_DIGIT, _LOW_HEX, _LOW, _UP_HEX, _UP, _MARK = (1 << n for n in range(6))
_KIND_OF = {
    char: kind
    for kind, chars in zip(
        (_DIGIT, _LOW_HEX, _LOW, _UP_HEX, _UP, _MARK),
        ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_-"),
    )
    for char in chars
}
#: Character classes from narrow to wide, each with the bits per character from which a window is suspect. A window
#: belongs to the first class that holds all of it; digits alone are numbers, never secrets. base36 holds base32 too.
CLASSES = (
    ("digits", (_DIGIT,), None),
    ("hex", (_DIGIT | _LOW_HEX, _DIGIT | _UP_HEX), 3.0),
    ("letters", (_LOW_HEX | _LOW, _UP_HEX | _UP), 3.4),
    ("base36", (_DIGIT | _LOW_HEX | _LOW, _DIGIT | _UP_HEX | _UP), 3.4),
    ("mixed", (63 ^ _DIGIT,), 3.9),  # names in camel case and paths are of this class
    ("base64", (63,), 3.75),
)
#: For each set of kinds the bits of its class.
_BITS = [next(bits for _, held, bits in CLASSES if any(kinds | h == h for h in held)) for kinds in range(64)]
#: Parts of candidates that are known not to be secrets; what stands before and behind them is looked at by itself.
_ALLOWED_PARTS = re.compile(
    r"""(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])  # uuid
    | wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY  # the key that manuals show
    | =""",
    re.VERBOSE,
)
#: Words that make the whole run of letters and digits around them an example.
_EXAMPLE_WORDS = re.compile("example|sample|dummy|placeholder", re.IGNORECASE)
_OUTSIDE_RUN = re.compile("[^A-Za-z0-9]")
#: Words joined by marks: only words as long as a window are looked at.
_WORDS = re.compile(r"[A-Za-z]+([_/-]+[A-Za-z]+)+")
_LONG_WORD = re.compile(rf"[A-Za-z]{{{WINDOW},}}")
_REPEATED = re.compile(r"(.{1,4}?)\1{4,}.{0,3}", re.DOTALL)


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; leftmost and not overlapping within each kind."""
    if any(hint in lowered for lowered in (text.lower(),) for hint in _ASSIGN_HINTS):
        for m in _ASSIGN.finditer(text):
            if m.end() - m.start(2) >= _ASSIGN_LEAST:
                yield m.start(), m.end(), "assign"
    if "AKIA" in text:
        yield from ((m.start(), m.end(), "access") for m in _ACCESS.finditer(text))
    if max(map(len, text.split()), default=0) >= _HEX_LEAST:
        yield from ((m.start(), m.end(), "hex") for m in _HEX.finditer(text))


def window_entropies(candidate: str, window: int = WINDOW) -> Iterator[float]:
    """Shannon entropy (bits per character) of each window, by counts that change by two characters a step."""
    terms = [0.0, *(n * log2(n) for n in range(1, window + 1))]
    counts: dict[str, int] = {}
    total = 0.0  # sum of n * log2(n) over the counts
    for i, char in enumerate(candidate):
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += terms[n + 1] - terms[n]
        if i >= window:
            gone = candidate[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += terms[n - 1] - terms[n]
        if i >= window - 1:
            yield log2(window) - total / window


def window_bits(candidate: str, window: int = WINDOW) -> Iterator[float | None]:
    """The least suspect entropy of each window, by its class: kinds are counted as characters enter and leave."""
    counts, held = dict.fromkeys(_KIND_OF.values(), 0), 0
    for i, char in enumerate(candidate):
        kind = _KIND_OF[char]
        counts[kind] += 1
        held |= kind
        if i >= window:
            gone = _KIND_OF[candidate[i - window]]
            counts[gone] -= 1
            if not counts[gone]:
                held &= ~gone
        if i >= window - 1:
            yield _BITS[held]


def allowed_parts(candidate: str) -> list[tuple[int, int]]:
    """Spans of the allowed parts, from the left and not overlapping, in time that follows the candidate's length.

    Example words are found bare and widened to the ends of their run, once a run.
    """
    spans = [(*m.span(), m.start()) for m in _ALLOWED_PARTS.finditer(candidate)]
    end = 0
    for word in _EXAMPLE_WORDS.finditer(candidate):
        if word.start() >= end:
            begin = max((m.end() for m in _OUTSIDE_RUN.finditer(candidate, end, word.start())), default=end)
            behind = _OUTSIDE_RUN.search(candidate, word.end())
            end = behind.start() if behind else len(candidate)
            spans.append((begin, end, word.start()))
        else:  # the last word of a run says whether what another part leaves of it still has one
            spans[-1] = (*spans[-1][:2], word.start())
    apart: list[tuple[int, int]] = []
    at = 0
    for begin, end, last in sorted(spans):
        if last >= at:
            apart.append((max(begin, at), end))
            at = end
    return apart


def _stretches(candidate: str, window: int) -> Iterator[tuple[int, str]]:
    """(start, text) of what is left of a candidate to look at, cut at '=' and at allowed parts."""
    at = 0
    for start, end in [*allowed_parts(candidate), (len(candidate), len(candidate))]:
        part = candidate[at:start]
        if len(part) >= window and not _REPEATED.fullmatch(part):
            if _WORDS.fullmatch(part):
                yield from ((at + m.start(), m.group()) for m in _LONG_WORD.finditer(part))
            else:
                yield at, part
        at = end


def entropy_spans(text: str, window: int = WINDOW) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the stretches of candidate strings whose windows are all suspect."""
    if max(map(len, text.split()), default=0) < window:
        return
    for m in _CANDIDATE.finditer(text):
        for offset, stretch in _stretches(m.group(), window):
            offset += m.start()
            begin = None
            for i, (entropy, bits) in enumerate(zip(window_entropies(stretch, window), window_bits(stretch, window))):
                if bits is not None and entropy >= bits - 1e-9:
                    begin, last = (i if begin is None else begin), i
                elif begin is not None and i > last + window:
                    yield offset + begin, offset + last + window, "entropy"
                    begin = None
            if begin is not None:
                yield offset + begin, offset + last + window, "entropy"


def _joined(spans: list[tuple[int, int, str]]) -> str:
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(text: str) -> dict:
    """What one document's row says; see ``scan_secrets``."""
    base, more = list(base_spans(text)), list(entropy_spans(text))
    kinds = [kind for _, _, kind in base]
    return {
        "n_assign": kinds.count("assign"),
        "n_access": kinds.count("access"),
        "n_hex": kinds.count("hex"),
        "n_entropy": len(more),
        "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(),
        "spans": _joined(base + more),
    }


_RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_entropy")]
    + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
)
_ARROW = [pa.int64()] * 4 + [pa.string()] * 2


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the secrets of every whole text.

    n_assign, n_access and n_hex: matches of the fixed patterns; n_entropy: stretches
    of suspect entropy; base_sha256: of the fixed patterns' spans; spans: all
    spans as kind:start:end (code points, end exclusive), comma-joined, by start and
    then kind. A null text counts as empty: no spans, and the hash of the empty
    string. Each row gives one row, repeated ones too; further columns of ``docs`` are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(text.as_py() or "") for text in batch.column(1)]
            columns = [pa.array([row[f.name] for row in found], kind) for f, kind in zip(_RESULT, _ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_RESULT.names])

    schema = T.StructType([docs.select("doc_id").schema[0], *_RESULT])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

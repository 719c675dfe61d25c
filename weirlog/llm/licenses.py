"""Licence scans: templates with optional and replaceable regions, run as token automata.

Each template is compiled to an automaton over words. All of them are joined, and their
joint states are made deterministic as texts reach them. A text is read once: from every
word that can begin a template the automaton runs on while some template still
fits, and a template is found where its whole mandatory wording was read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .license_templates import PHRASES, TEMPLATES

_MARK = re.compile(r"<<(optional|end|any:\d+)>>")
#: Lower-cases A-Z and turns all bytes outside words into blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, in UTF-8."""
    return text.translate(_FOLD).split()


class Automaton:
    """Templates, compiled. ``templates`` are (label, markup); what a match gives is the template's number."""

    def __init__(self, templates: Iterable[tuple[str, str]]):
        self.templates = tuple(templates)
        self._steps: list[dict[bytes | None, set[int]]] = []  # None: any word
        self._skips: list[set[int]] = []
        self._ends: dict[int, int] = {}
        starts = {self._compile(number, markup) for number, (_, markup) in enumerate(self.templates)}
        self._vocabulary = {word for step in self._steps for word in step}
        self._known: dict[frozenset[int], int] = {}
        self._next: list[dict[bytes | None, int]] = []
        self._sets: list[frozenset[int]] = []
        self._found: list[tuple[int, ...]] = []
        self._start = self._state(starts)
        self.first = frozenset(w for s in self._sets[self._start] for w in self._steps[s])
        if None in self.first or self._found[self._start]:
            raise ValueError("a template must begin with mandatory or optional wording and contain some")

    def _new(self) -> int:
        self._steps.append({})
        self._skips.append(set())
        return len(self._steps) - 1

    def _compile(self, number: int, markup: str) -> int:
        start = at = self._new()
        opened: list[int] = []
        for i, part in enumerate(_MARK.split(markup)):
            if i % 2 == 0:
                for word in words_of(part.encode()):
                    after = self._new()
                    self._steps[at].setdefault(word, set()).add(after)
                    at = after
            elif part == "optional":
                opened.append(at)
            elif part == "end":
                if not opened:
                    raise ValueError(f"end without optional in template {number}")
                self._skips[opened.pop()].add(at)
            else:
                before = [at]
                for _ in range(int(part[4:])):
                    after = self._new()
                    self._steps[at].setdefault(None, set()).add(after)
                    at = after
                    before.append(at)
                for state in before[:-1]:
                    self._skips[state].add(at)
        if opened:
            raise ValueError(f"optional without end in template {number}")
        self._ends[at] = number
        return start

    def _state(self, states: Iterable[int]) -> int:
        """The number of a joint state, with all that can be reached by leaving wording out."""
        todo, closed = list(states), set()
        while todo:
            state = todo.pop()
            if state not in closed:
                closed.add(state)
                todo.extend(self._skips[state])
        key = frozenset(closed)
        if key not in self._known:
            self._known[key] = len(self._sets)
            self._sets.append(key)
            self._next.append({})
            self._found.append(tuple(sorted(self._ends[s] for s in key if s in self._ends)))
        return self._known[key]

    def _step(self, state: int, word: bytes) -> int:
        """The state after ``word``, -1 if no template goes on. Words that no template names share one entry."""
        row = self._next[state]
        key = word if word in self._vocabulary else None
        after = row.get(key)
        if after is None:
            steps = [self._steps[s] for s in self._sets[state]]
            reached = set().union(*(step.get(None, ()) for step in steps))
            if key is not None:
                reached = reached.union(*(step.get(key, ()) for step in steps))
            after = row[key] = self._state(reached) if reached else -1
        return after

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, start, end) of every place where a template fits; of one start, its longest end."""
        first, n = self.first, len(words)
        for start in [i for i, word in enumerate(words) if word in first]:
            state, at, ends = self._start, start, {}
            while at < n and (state := self._step(state, words[at])) >= 0:
                at += 1
                for number in self._found[state]:
                    ends[number] = at
            for number, end in sorted(ends.items()):
                yield number, start, end


def scan(words: list[bytes], automaton: Automaton, n_phrases: int) -> dict:
    """What one document's row says; see ``scan_licenses``."""
    base: list[int] = []
    base_labels, labels = set(), set()
    covered = reached = 0
    for number, start, end in automaton.matches(words):
        label = automaton.templates[number][0]
        labels.add(label)
        if number < n_phrases:
            base.append(start)
            base_labels.add(label)
        covered += max(0, end - max(start, reached))
        reached = max(reached, end)
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(base, default=None),
        "last_word": max(base, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels)),
        "score": covered / len(words) if words else 0.0,
    }


_RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType())]
)


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id and the licence findings of every whole text.

    n_words; n_base, first_word and last_word: the places where a phrase's words stand
    consecutively, and the smallest and largest word number at which one starts (null if
    none); base_labels and labels: labels of the phrases and of all that was found,
    distinct, sorted, comma-joined (empty if none); score: the share of the words that
    lie in something found. A null or empty text has no words and score 0. Each row
    gives one row, repeated ones too; further columns of ``docs`` are not read.
    """
    phrases, joint = tuple(phrases), (*phrases, *templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(joint)
        for batch in batches:
            found = [scan(words_of(text.as_py() or b""), automaton, len(phrases)) for text in batch.column(1)]
            columns = [pa.array([row[f.name] for row in found], kind) for f, kind in zip(_RESULT, _ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_RESULT.names])

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    schema = T.StructType([docs.select("doc_id").schema[0], *_RESULT])
    return rows.mapInArrow(run, schema)


_ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

"""Language identification by cross-parsing: which language's text parses a document into the fewest phrases.

For each language a suffix automaton holds all substrings of a sample of labelled text. A
document is parsed against it greedily: each phrase is the longest match from
where the last one ended. phrases * log2(sample length) / characters estimates the
cross entropy; a letter that a sample lacks costs the same and more than any phrase in every
language, so that a label with next to no text cannot win by its short length. The
language with the least wins.

The automata are laid out in one table, each by state and its own letters, and a task walks many pieces
of texts through it side by side. A text is parsed whole, in blocks of ``BLOCK`` symbols, at
whose ends a phrase ends too, for every language alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim_worker, stored

#: Bounds of the labelled sample: documents a language, characters of one, and characters of a language in all.
SAMPLE_DOCS, DOC_CHARS, SAMPLE_CHARS = 64, 2_048, 16_384
#: Letters that a language's part of the table tells apart; rarer ones of that language match nothing in it.
LETTERS = 1_000
#: Symbols that are parsed in one go, and pieces that are walked side by side.
BLOCK, PIECES = 512, 4_096
#: What is said of a text without letters.
UNKNOWN = "und"

_SPACE, _STRANGE, _FIRST = 0, 1, 2


def held_out(doc_id: str | Column) -> Column:
    """True for the quarter of the documents that nothing is learned from. A null id counts as empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


class SuffixAutomaton:
    """All substrings of a sequence of symbols: ``next[s]`` maps a symbol to the state after it; state 0 is empty."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        self._link, self._longest, self._last = [-1], [0], 0
        for symbol in symbols:
            self._extend(int(symbol))

    def _state(self, longest: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self._longest.append(longest)
        self._link.append(link)
        return len(self.next) - 1

    def _extend(self, symbol: int) -> None:
        whole = self._state(self._longest[self._last] + 1, 0, {})
        at, self._last = self._last, whole
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = whole
            at = self._link[at]
        if at < 0:
            return
        other = self.next[at][symbol]
        if self._longest[other] == self._longest[at] + 1:
            self._link[whole] = other
            return
        split = self._state(self._longest[at] + 1, self._link[other], dict(self.next[other]))
        while at >= 0 and self.next[at].get(symbol) == other:
            self.next[at][symbol] = split
            at = self._link[at]
        self._link[other] = self._link[whole] = split


class Model:
    """The learned languages' automata as one table. Picklable; sent to the workers once."""

    def __init__(self, samples: dict[str, str]):
        """``samples``: text of each language."""
        self.languages = sorted(samples)
        own = [self._letters(samples[language]) for language in self.languages]
        self.letters = sorted(set().union(*own))
        numbers = {letter: number for number, letter in enumerate(self.letters, _FIRST)}
        tables, self.roots, self.bits, size = [], [], [], 0
        #: For each language and symbol the column of its part of the table; strange where the language lacks the letter.
        self.columns = np.full((len(own), _FIRST + len(self.letters)), _STRANGE, np.int32)
        self.columns[:, _SPACE] = _SPACE
        for columns, language, letters in zip(self.columns, self.languages, own):
            columns[[numbers[letter] for letter in letters]] = np.arange(_FIRST, _FIRST + len(letters))
            symbols = columns[self.symbols(samples[language])]
            self.roots.append(size)
            self.bits.append(float(np.log2(len(symbols) + 1)))
            tables.append(self._table(SuffixAutomaton(symbols), size, _FIRST + len(letters)))
            size += len(tables[-1])
        self.missing_bits = max(self.bits, default=0.0) + float(np.log2(_FIRST + len(self.letters)))
        self.table = np.concatenate([*tables, np.zeros(0, np.int32)])

    @staticmethod
    def _letters(sample: str) -> list[str]:
        counts = Counter(c for c in sample.lower() if c.isalpha())
        return sorted(sorted(counts, key=lambda c: (-counts[c], c))[:LETTERS])

    def _table(self, automaton: SuffixAutomaton, root: int, width: int) -> np.ndarray:
        """For (state, column) four times the next state's first cell plus the phrases that the step completes.

        A strange letter ends a phrase and is one; where no match goes on, a phrase ends
        and the symbol begins another.
        """
        table = np.empty((len(automaton.next), width), np.int32)
        restart = np.full(width, 4 * root + 1, np.int32)  # the symbol itself is a phrase
        for symbol, state in automaton.next[0].items():
            restart[symbol] = 4 * (root + state * width)
        table[:] = restart + 1
        table[0] = restart
        for state, after in enumerate(automaton.next):
            if after:
                table[state, list(after)] = [4 * (root + s * width) for s in after.values()]
        table[:, _STRANGE] = 4 * root + 2
        table[0, _STRANGE] = 4 * root + 1
        return table.ravel()

    def symbols(self, text: str) -> np.ndarray:
        """Lower-cased letters by number; a run of anything else is one blank."""
        if not hasattr(self, "_numbers"):
            self._numbers = np.array([_STRANGE if chr(c).isalpha() else _SPACE for c in range(0x110000)], np.int32)
            for number, letter in enumerate(self.letters, _FIRST):
                self._numbers[ord(letter)] = number
        found = self._numbers[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        blank = found == _SPACE
        return found[~(blank & np.concatenate([[False], blank[:-1]]))] if len(found) else found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_numbers"}

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        result = np.zeros((len(texts), len(self.languages)), np.int64)
        if not sizes.sum() or not self.languages:
            return result
        joined = np.concatenate(texts)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        for part in np.array_split(order, -(-len(order) // PIECES)):
            found = self._walk(joined, start[part], length[part])
            for language in range(len(self.languages)):
                result[:, language] += np.bincount(owner[part], found[language], len(texts)).astype(np.int64)
        return result

    def _walk(self, joined: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of pieces (longest first) in each language."""
        roots = np.array(self.roots, np.int32)[:, None]
        state, count = np.repeat(roots, len(start), axis=1), np.zeros((len(roots), len(start)), np.int32)
        steps = int(length[0])
        symbols = joined[np.minimum(start + np.arange(steps)[:, None], len(joined) - 1)].astype(np.int32)
        active = len(length) - np.searchsorted(length[::-1], np.arange(steps), "right")
        for step in range(steps):
            n = active[step]
            cell = self.table.take(state[:, :n] + self.columns.take(symbols[step, :n], axis=1))
            count[:, :n] += cell & 3
            state[:, :n] = cell >> 2
        return count + (state != roots)

    def missing(self, texts: list[np.ndarray]) -> np.ndarray:
        """Letters of each text (rows) that each language (columns) lacks."""
        lacks = (self.columns == _STRANGE).T.astype(np.int64)
        counts = [np.bincount(text, minlength=len(lacks)) for text in texts]
        return np.array([n[n > 0] @ lacks[n > 0] for n in counts]).reshape(len(texts), len(self.languages))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is 1 - least / second least entropy, 0 where nothing is known."""
        known = [bool(self.languages) and readable(text) for text in texts]
        symbols = [self.symbols(text) if ok else np.zeros(0, np.int32) for text, ok in zip(texts, known)]
        missing = self.missing(symbols)  # each is a phrase of its own
        entropy = (self.phrases(symbols) - missing) * np.array(self.bits)[None, :] + missing * self.missing_bits
        result = []
        for ok, row in zip(known, entropy):
            if not ok:
                result.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmin(row))  # of equals the first by name
            others = np.delete(row, best)
            result.append((self.languages[best], 1.0 - float(row[best] / others.min()) if len(others) else 1.0))
        return result


def learn(docs: DataFrame) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out.

    Of each language the ``SAMPLE_DOCS`` documents whose texts have the smallest hashes
    (equal texts count once) give ``DOC_CHARS`` characters each, ``SAMPLE_CHARS`` in all.
    """
    rows = docs.where(~held_out("doc_id")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    hashed = rows.select("lang", F.xxhash64("text").alias("hash"), F.substring("text", 1, DOC_CHARS).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    lowest = hashed.select("lang", "hash").distinct().withColumn("nth", nth).where(F.col("nth") <= SAMPLE_DOCS)
    # The sample is bounded: SAMPLE_DOCS rows a language.
    chosen = hashed.join(F.broadcast(stored(lowest, "sample")), ["lang", "hash"])
    chosen = chosen.groupBy("lang", "nth").agg(F.min("text").alias("text"))
    samples: dict[str, str] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r.lang, r.nth)):
        samples[row.lang] = (samples.get(row.lang, "") + "\n" + row.text)[:SAMPLE_CHARS]
    return Model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    lang_pred is the learned language that needs the fewest normalised phrases (of
    equals the first by name), or ``und`` with score 0 if the text is null or has no
    letter, or if no language was learned. Only the text is looked at. Each row gives
    one row, repeated ones too; an empty table gives none; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("language")
        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(start, _TEXTS)
                found = sent.value.predict(part.column(2).to_pylist())
                language, score = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), language, score], names=names)

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields[:2], *new])
    names = schema.names
    return rows.mapInArrow(run, schema)


def readable(text: str | None) -> bool:
    """Whether a text has a letter at all; without one it has no language."""
    return text is not None and any(map(str.isalpha, text))


def drop_unidentified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents whose text is null or has no letter; lang becomes the prediction.

    All columns stay. Every text that is left is parsed whole, and what ``identify`` says of it replaces a given
    label too: labels are learned from, whatever they are called, and what follows goes by the texts. If no
    language was learned, nothing is predicted, lang stays and no further document goes. A table without a column
    lang loses rows only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("language")
        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(start, _TEXTS)
                part = part.filter(pa.array(list(map(readable, part.column(place).to_pylist())), pa.bool_()))
                if lang is not None and sent.value.languages and part.num_rows:
                    found = [language for language, _ in sent.value.predict(part.column(place).to_pylist())]
                    part = part.set_column(lang, part.schema.field(lang), pa.array(found, part.column(lang).type))
                yield part

    return docs.mapInArrow(run, docs.schema)


#: Texts that are walked together.
_TEXTS = 300

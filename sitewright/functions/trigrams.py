"""Counts of character trigrams in batches of texts, as small array functions for Arrow batches.

A list of all trigrams of a text is many times its size. These functions number the characters of many texts at once, so a trigram is
one whole number, and only counts leave them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

CHARACTERS = 1_000_000  # characters held as numbers at once, if no single text is longer
TEXTS = 1_000
TABLE = 4_000_000  # trigrams that a table may have a place for; with larger alphabets they are sorted
END = "\n"  # between texts; letters have no line break
# each run of blanks, digits and ASCII punctuation counts as one blank
GAPS = bytes(32 if x < 128 and (chr(x) in " \t\n\v\f\r" or 33 <= x <= 64 or 91 <= x <= 96 or 123 <= x <= 126) else x for x in range(256))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, str]]:
    """(begin, end, letters of the texts joined) for runs of rows of bounded size; null counts as empty."""
    begin, held, size = 0, [], 0
    for place, value in enumerate(texts):
        text = (value.as_py() or b"").translate(GAPS).decode("utf-8", "replace")
        if held and (size + len(text) > CHARACTERS or len(held) == TEXTS):
            yield begin, place, END.join(held)
            begin, held, size = place, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield begin, begin + len(held), END.join(held)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _numbers(joined: str) -> np.ndarray:
    """Code points without the blanks that follow a blank."""
    codes = _code_points(joined)
    blank = codes == ord(" ")
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


def _keys(characters: np.ndarray, base: int) -> np.ndarray:
    """Number of the trigram that begins at each place but the last two."""
    wide = characters.astype(np.int64)
    return (wide[:-2] * base + wide[1:-1]) * base + wide[2:]


def count_trigrams(joined: str) -> tuple[list[str], np.ndarray]:
    """Distinct trigrams inside the texts and how often they occur."""
    codes = _numbers(joined)
    if len(codes) < 3:
        return [], np.zeros(0, np.int64)
    alphabet = np.flatnonzero(np.bincount(codes))
    place = np.zeros(alphabet[-1] + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    base = len(alphabet)
    keys = _keys(place[codes], base)
    ends = codes == ord(END)
    keys = keys[~(ends[:-2] | ends[1:-1] | ends[2:])]
    if base**3 <= TABLE:
        counts = np.bincount(keys, minlength=1)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(keys, return_counts=True)
    letters = [alphabet[x] for x in (found // base**2, found // base % base, found % base)]
    return ["".join(map(chr, t)) for t in zip(*[x.tolist() for x in letters], strict=True)], counts


def count_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker function: (lang, lower-case text as binary) -> (lang, term, n) with the counts of each run of texts."""
    names = ["lang", "term", "n"]
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            mine = batch.column(1).filter(pa.array([x == lang for x in langs]))
            for _, _, joined in _chunks(mine):
                terms, counts = count_trigrams(joined)
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)


class TermFinder:
    """Finds the known trigrams of texts."""

    def __init__(self, terms: Sequence[str]):
        known = _code_points("".join(terms)).reshape(-1, 3)
        self.alphabet = np.unique(known)
        self.base = len(self.alphabet) + 1  # 0 stands for all other characters
        self.keys = _keys(self._places(known.ravel()), self.base)[::3] if len(known) else np.zeros(0, np.int64)
        self.order = np.argsort(self.keys)
        self.table = None
        if self.base**3 <= TABLE:
            self.table = np.full(self.base**3, -1, np.int64)
            self.table[self.keys] = np.arange(len(self.keys))

    def _places(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, codes)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == codes, at + 1, 0) if len(self.alphabet) else np.zeros(len(codes), np.int64)

    def counts(self, joined: str, texts: int) -> np.ndarray:
        """Occurrences per text and known trigram."""
        codes = _numbers(joined)
        made = np.zeros((texts, len(self.keys)), np.int64)
        if len(codes) < 3 or not len(self.keys):
            return made
        distinct = np.flatnonzero(np.bincount(codes))
        place = np.zeros(distinct[-1] + 1, np.int64)
        place[distinct] = self._places(distinct)
        keys = _keys(place[codes], self.base)
        if self.table is not None:
            found = self.table[keys]
        else:
            at = np.minimum(np.searchsorted(self.keys, keys, sorter=self.order), len(self.keys) - 1)
            found = np.where(self.keys[self.order[at]] == keys, self.order[at], -1)
        hits = np.flatnonzero(found >= 0)
        owner = np.cumsum(codes == ord(END))[hits]  # no known trigram has the mark, so a hit is inside one text
        return np.bincount(owner * len(self.keys) + found[hits], minlength=made.size).reshape(made.shape)


def best_class(terms: Sequence[str], codes: Sequence[str], weights: np.ndarray, prior: np.ndarray, unknown: str):
    """Worker function: lower-case texts as binary -> code with the highest sum of prior and weights (classes x terms)."""
    finder: list[TermFinder] = []

    def run(texts: pa.Array) -> pa.Array:
        if not finder:
            finder.append(TermFinder(terms))
        found: list[str] = []
        for begin, end, joined in _chunks(texts):
            counts = finder[0].counts(joined, end - begin)
            best = (counts @ weights.T + prior).argmax(axis=1)
            found += [codes[i] if any_known else unknown for i, any_known in zip(best.tolist(), counts.any(axis=1).tolist(), strict=True)]
        return pa.array(found, pa.string())

    return run

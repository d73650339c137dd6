"""Clean texts, several versions of a text in one pass: a small Arrow function for each batch of rows.

Cleaning word by word with lambdas over arrays was the costliest step of the text jobs. Here a text is cut into words once
for all versions, and a task remembers the stems of the words it has met.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = bytes(range(256)).lower()
OTHERS = bytes(set(range(256)) - set(LETTERS + b" "))  # bytes of other characters, in UTF-8
REMEMBERED = 200_000  # stems a task remembers per language; then it starts anew


@dataclass(frozen=True)
class Recipe:
    """One version of a text: words of ``min_length`` letters, of which ``least`` must be left, else null.

    ``stop`` has the words to leave out per language, ``rules`` the suffixes and what replaces them. With either,
    texts in a language that it does not list are null.
    """

    min_length: int = 3
    least: int = 0
    stop: Mapping[str, frozenset[bytes]] | None = None
    rules: Mapping[str, Mapping[bytes, bytes]] | None = None
    min_stem: int = 3


class _Stems(dict):
    """Stem per word: the longest suffix with a rule that leaves at least ``min_stem`` letters is replaced."""

    def __init__(self, rules: Mapping[bytes, bytes], min_stem: int):
        super().__init__()
        self.rules, self.min_stem, self.longest = rules, min_stem, max(map(len, rules), default=0)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        stem = word
        for cut in range(max(self.min_stem, len(word) - self.longest), len(word)):
            if word[cut:] in self.rules:
                stem = word[:cut] + self.rules[word[cut:]]
                break
        self[word] = stem
        return stem


def _versions(recipes: Sequence[Recipe]):
    """Worker function: (text as binary, language) -> array with a text or null per recipe."""
    lengths = sorted({r.min_length for r in recipes})
    stems = [{code: _Stems(rules, r.min_stem) for code, rules in (r.rules or {}).items()} for r in recipes]

    def run(text: pa.Array, language: pa.Array) -> pa.Array:
        made = []
        for value, code in zip(text, language.to_pylist(), strict=True):
            raw = value.as_py()
            if raw is None:
                made += [None] * len(recipes)
                continue
            words = raw.translate(LOWER, OTHERS).split()
            long = {n: [w for w in words if len(w) >= n] for n in lengths}
            for recipe, known in zip(recipes, stems, strict=True):
                kept = long[recipe.min_length]
                if any(needed is not None and code not in needed for needed in (recipe.stop, recipe.rules)):
                    made.append(None)
                    continue
                if recipe.stop is not None:
                    left_out = recipe.stop[code]
                    kept = [w for w in kept if w not in left_out]
                if len(kept) < recipe.least:
                    made.append(None)
                    continue
                made.append(b" ".join(map(known[code].__getitem__, kept) if recipe.rules is not None else kept))
        ends = pa.array(range(0, len(made) + 1, len(recipes)), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(made, pa.binary()).cast(pa.string()))

    return run


def versions(text: Column, language: Column, recipes: Sequence[Recipe]) -> Column:
    """Array with the text of every recipe: letters A-Z and blanks only, lower case, words single-spaced; null for null.

    Other characters vanish, so words around a line break join up. Not for use inside a lambda.
    """
    return F.arrow_udf(_versions(recipes), "array<string>")(text.cast("binary"), language)

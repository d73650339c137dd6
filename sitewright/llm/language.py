"""Language proportions of a text by expectation maximization over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.texts import narrow, slices
from sitewright.sources.tables import save_stage

UNKNOWN = "und"
NGRAM = 3
ROWS_PER_LANGUAGE = 4_000  # bound of the fitting sample, by hash of doc_id
GRAMS_PER_LANGUAGE = 4_000  # most frequent n-grams kept per language
SMOOTHING = 0.5
STEP = 0.25  # n-grams whose log-likelihoods agree to this many nats are counted together
ROUNDS = 30
MIN_SHARE = 0.01  # proportion in the full mixture from which a language is considered
PENALTY = 4.0  # times log(n-grams) for each further language
SLICE = 500_000  # characters handled at a time


def letter_table():
    """True for every code point that is a letter."""
    import numpy as np

    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_codes(pieces: list[tuple[int, str]], letters):
    """(owner, code) of every n-gram of a slice, and the owners of all letters.

    Text is lower-cased, every run of other characters becomes one space, and every piece has a space in front.
    """
    import numpy as np

    lowered = [" " + text.lower() + " " for _, text in pieces]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owners = np.repeat(np.fromiter((i for i, _ in pieces), np.int64, len(pieces)), lengths)
    chars = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32).astype(np.int64)
    is_letter = letters[chars]
    chars[~is_letter] = 32
    keep = np.ones(len(chars), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    chars, owners, with_letter = chars[keep], owners[keep], owners[is_letter]
    codes = (chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:]
    own = owners[:-2] == owners[2:]
    return owners[:-2][own], codes[own], with_letter


@dataclass
class LanguageModel:
    """Likelihood of every kept n-gram in every language; n-grams with the same profile share a class.

    Shipped to workers, so it refers to nothing outside this subpackage.
    """

    languages: list[str]
    codes: object  # sorted n-gram codes
    classes: object  # class of each code
    profiles: object  # (classes, languages): likelihoods up to a factor per class
    common: int  # position of the language with most n-grams

    def histograms(self, owners, codes, rows: int):
        """(rows, classes): how often the n-grams of each class occur."""
        import numpy as np

        if not len(self.codes):
            return np.zeros((rows, len(self.profiles)))
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        width = len(self.profiles)
        flat = owners[known] * width + self.classes[at[known]]
        return np.bincount(flat, minlength=rows * width).reshape(rows, width).astype(float)

    def _maximize(self, counts, allowed):
        """Proportions of each row among the allowed languages and their log-likelihood."""
        import numpy as np

        shares = allowed / allowed.sum(axis=1, keepdims=True)
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        for _ in range(ROUNDS):
            mixed = np.maximum(shares @ self.profiles.T, 1e-300)
            shares = shares * ((counts / mixed) @ self.profiles) / total
            shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
        return shares, (counts * np.log(np.maximum(shares @ self.profiles.T, 1e-300))).sum(axis=1)

    def proportions(self, counts, penalty: float = PENALTY):
        """(rows, languages): proportions within the chosen language set.

        Languages are ordered by their proportion in the full mixture; of the leading one, two, three ... languages, the
        set with the largest log-likelihood less ``penalty * log(n)`` per further language is chosen. A language with next to
        no proportion in the full mixture is not considered.
        """
        import numpy as np

        size = len(self.languages)
        full, _ = self._maximize(counts, np.ones((len(counts), size)))
        order = np.argsort(-full, axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        cost = penalty * np.log(np.maximum(counts.sum(axis=1), 2))
        best = (place == 0).astype(float)
        value = (counts * np.log(self.profiles.T[order[:, 0]])).sum(axis=1)
        for k in range(2, size + 1):
            rows = np.flatnonzero(full[np.arange(len(full)), order[:, k - 1]] > MIN_SHARE)
            if not len(rows):
                break
            shares, fit = self._maximize(counts[rows], (place[rows] < k).astype(float))
            fit = fit - cost[rows] * (k - 1)
            better = fit > value[rows]
            best[rows[better]], value[rows[better]] = shares[better], fit[better]
        none = counts.sum(axis=1) == 0  # letters, but no known n-gram
        best[none] = 1 / size + np.eye(size)[self.common] * 1e-9
        return best


def count_partitions():
    """Worker function: (lang, text) -> lang, code, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        letters = letter_table()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            numbers = {name: i for i, name in enumerate(dict.fromkeys(langs))}
            names = list(numbers)
            of_row = np.array([numbers[name] for name in langs], np.int64)
            for pieces in slices(batch.column(1).to_pylist(), SLICE, NGRAM - 1):
                owners, codes, _ = gram_codes(pieces, letters)
                for number in np.unique(of_row[owners]).tolist():
                    code, n = np.unique(codes[of_row[owners] == number], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[number]] * len(code), pa.string()), pa.array(code), pa.array(n, pa.int64())],
                        names=["lang", "code", "n"],
                    )

    return run


def fit_model(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    grams_per_language: int = GRAMS_PER_LANGUAGE,
) -> LanguageModel:
    """Fit on a bounded sample: about ``rows_per_language`` rows of each language, all of rarer ones."""
    import numpy as np

    rows = narrow(docs, key=key, text=text, lang=lang).filter("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), 0)
    shares = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, rows_per_language / n))])
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(place < shares[F.col("lang")]).select("lang", "text")
    counts = save_stage(
        sample.mapInArrow(count_partitions(), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")),
        "grams",
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= grams_per_language)
    found = counts.join(top.select("code").distinct(), "code", "left_semi").collect()  # languages times kept n-grams
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    languages = sorted(sizes)
    codes = np.array(sorted({r["code"] for r in found}), np.int64)
    table = np.zeros((len(codes), len(languages)))
    column = {name: i for i, name in enumerate(languages)}
    for r in found:
        table[np.searchsorted(codes, r["code"]), column[r["lang"]]] = r["n"]
    size = np.array([totals.get(name, 0) for name in languages], float)
    logs = np.log((table + SMOOTHING) / (size + SMOOTHING * (len(codes) + 1)))
    logs = np.round((logs - logs.max(axis=1, keepdims=True, initial=-np.inf)) / STEP) * STEP
    profiles, classes = np.unique(logs, axis=0, return_inverse=True)
    return LanguageModel(languages, codes, classes.reshape(-1), np.exp(profiles), int(np.argmax(size)))


def predict_partitions(model: LanguageModel, penalty: float):
    """Worker function: (row, text) -> row, lang_pred, score, mixture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        letters = letter_table()

        def finish(rows: int, counts, lettered):
            langs, scores, mixtures = [UNKNOWN] * rows, [0.0] * rows, [[] for _ in range(rows)]
            at = np.flatnonzero(lettered)
            if len(at) and model.languages:
                for i, share in zip(at.tolist(), model.proportions(counts[at], penalty), strict=True):
                    top = int(np.argmax(share))
                    langs[i], scores[i] = model.languages[top], min(1.0, float(share[top]))
                    mixtures[i] = [
                        {"lang": name, "share": float(p)} for name, p in zip(model.languages, share, strict=True) if p > 0.005
                    ]
            return langs, scores, mixtures

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                rows = part.num_rows
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts, lettered = np.zeros((rows, len(model.profiles))), np.zeros(rows, bool)
                for pieces in slices(texts, SLICE, NGRAM - 1):
                    owners, codes, with_letter = gram_codes(pieces, letters)
                    counts += model.histograms(owners, codes, rows)
                    lettered[with_letter] = True
                langs, scores, mixtures = finish(rows, counts, lettered)
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(mixtures, kind)],
                    names=["row", "lang_pred", "score", "mixture"],
                )

    return run


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row per document: row (all columns as a struct), lang_pred, score, mixture.

    The score is the proportion of the predicted language, the mixture lists all languages of the chosen set. A text that is
    null or has no letter gets ``und``, score 0 and no mixture, and so does every text if nothing could be learned; letters
    without any known n-gram give the most frequent language with equal shares. Of equal proportions the first language
    in order wins. Only the text is looked at. Repeated rows come out each, an empty table gives no rows, and other columns
    keep their names inside ``row``. Row-local: no shuffle, any length in bounded memory besides the text itself.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        predict_partitions(model, penalty),
        f"row {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>",
    )


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of ids that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from the labelled documents that are not held out; rows without id are left out as well."""
    return fit_model(docs.filter(F.col(doc_id).isNotNull() & ~held_out(doc_id)), text, lang, doc_id)


def known_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with any recognizable language, mixed or not; the others are rejected.

    A model without languages (no labelled document) recognizes nothing, so then only texts without a letter are rejected.
    """
    if not model.languages:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    return identify(docs, model, text).filter(F.col("lang_pred") != UNKNOWN).select("row.*")

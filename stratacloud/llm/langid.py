"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Texts are lower-cased; features are hashed byte n-grams (2 and 3 bytes with the spaces around words). All machines are
linear without bias, so a text's verdict is the sign of a sum of weights over its n-grams, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm._shared import bounded, crc_remainder, read_table

#: Rows per language that the machines are fitted on: those whose hash lies in a share of all that gives about this many.
TRAINING_ROWS = 500
#: Rows that the machines are fitted on in all; many languages share them.
TRAINING_TOTAL = 20_000
SLOTS = 1 << 13
#: ISO 639-1 codes by family. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "pl", "cs", "uk", "bg", "sk"],
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def slots(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature slots of the 2-grams and 3-grams that start at each byte."""
    x = data.astype(np.uint32)
    two = ((x[:-1] * np.uint32(0x9E37) + x[1:] * np.uint32(0x79B9) * np.uint32(31)) * np.uint32(0x85EBCA6B)) >> np.uint32(19)
    three = ((x[:-2] + x[1:-1] * np.uint32(0x0101F1) + x[2:] * np.uint32(0x5F356495)) * np.uint32(0xC2B2AE35)) >> np.uint32(19)
    return two.astype(np.int64), three.astype(np.int64)


def prepared(text: str | None) -> bytes:
    return b" " + " ".join((text or "").lower().split()).encode("utf-8", "replace") + b" "


def has_letters(text: str | None) -> bool:
    """Letters by Unicode category; digits, fractions and enclosed numbers are none."""
    return any(c.isalpha() for c in text or "")


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their counts."""
    two, three = slots(np.frombuffer(prepared(text), np.uint8))
    counts = np.bincount(two, minlength=SLOTS) + np.bincount(three, minlength=SLOTS)
    at = np.flatnonzero(counts)
    return at, counts[at]


Row = tuple[np.ndarray, np.ndarray]


def svm(x: list[Row], y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Linear SVM without bias (y is -1 or 1) over sparse rows, by dual coordinate descent in a fixed order; classes weigh the same."""
    w, alpha = np.zeros(SLOTS), np.zeros(len(y))
    square = np.array([v @ v for _, v in x]) + 1e-12
    top = cost * len(y) / 2 / np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1))
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = x[i]
            new = min(max(alpha[i] - (y[i] * (w[at] @ v) - 1) / square[i], 0), top[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


class Model:
    """Weights of all machines side by side: one per family against the rest (none if there is one), one per pair."""

    def __init__(self, x: list[Row], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(x) for x in self.langs})
        seen = np.zeros(SLOTS)
        for at, _ in x:
            seen[at] += 1
        weight = 1 / np.sqrt(seen / len(x) + 1e-3)
        x = [(at, np.sqrt(n) * weight[at]) for at, n in x]
        x = [(at, v / (np.linalg.norm(v) + 1e-12)) for at, v in x]
        names = np.array(langs)
        family = np.array([family_of(n) for n in langs])
        columns, self.family_columns = [], []
        for f in self.families if len(self.families) > 2 else self.families[:-1]:
            self.family_columns.append(len(columns))
            columns.append(svm(x, np.where(family == f, 1.0, -1.0)))
        self.pairs = []
        for f in self.families:
            for a, b in combinations([n for n in self.langs if family_of(n) == f], 2):
                own = np.flatnonzero((names == a) | (names == b))
                self.pairs.append((a, b, len(columns)))
                columns.append(svm([x[i] for i in own], np.where(names[own] == a, 1.0, -1.0)))
        self.norm = weight
        self.weights = (np.stack(columns, 1) * weight[:, None]) if columns else np.zeros((SLOTS, 0))

    def predict(self, roots: np.ndarray) -> tuple[str, float]:
        """roots: the normalised sums of the machines for one text."""
        sure = 1.0
        sigma = lambda m: 1 / (1 + np.exp(-4 * min(max(m, -8), 8)))
        if len(self.families) == 1:
            family = self.families[0]
        elif len(self.families) == 2:
            m = roots[self.family_columns[0]]
            family, sure = self.families[0 if m >= 0 else 1], sigma(abs(m))
        else:
            margins = roots[self.family_columns]
            k = int(np.argmax(margins))
            family, sure = self.families[k], sigma(margins[k])
        votes = {n: [0, 0.0] for n in self.langs if family_of(n) == family}
        for a, b, k in self.pairs:
            if a in votes:
                win, m = (a, roots[k]) if roots[k] >= 0 else (b, -roots[k])
                votes[win][0] += 1
                votes[win][1] += m
        best = max(votes, key=lambda n: (*votes[n], n))
        pair = [sigma(abs(roots[k])) for a, b, k in self.pairs if best in (a, b)]
        return best, float(sure * (min(pair) if pair else 1.0))


@bounded
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [vector(text) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 1))], names=["lang", "at", "n"])


def train(docs: DataFrame, rows: int = TRAINING_ROWS, total: int = TRAINING_TOTAL) -> Model | None:
    """Fit on about ``rows`` rows of each language, ``total`` of all; rows without language or text take no part.

    Rows are chosen by a hash of their text and id, so that no order or window over all of them is needed; equal rows
    count once.
    """
    usable = docs.filter("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), "doc_id")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = min(rows, max(total // len(counts), 1))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))])
    place = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.filter(place < F.element_at(share, F.col("lang"))).dropDuplicates()
    sample = chosen.select("text", "lang").mapInArrow(_vectors, "lang string, at array<int>, n array<int>").collect()
    sample = sorted(((r["lang"], r["at"], r["n"]) for r in sample if len(r["at"])))
    if not sample:
        return None
    return Model([(np.array(at), np.array(n, float)) for _, at, n in sample], [lang for lang, _, _ in sample])


def _predicted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = [], []
            for text in texts:
                if not text or model is None or not has_letters(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at, counts = vector(text)
                roots = np.sqrt(counts)
                scaled = roots @ model.weights[at]
                lang, score = model.predict(scaled / (np.linalg.norm(roots * model.norm[at]) + 1e-12))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return bounded(run)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of rows (doc_id, ..., text): text is the last column and the only one that is read."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(_predicted(model), fields + ", lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the language that its text alone gives; rows of remainder 1 are held out of the fit.

    Null texts and texts without letters are ``und`` with score 0, and so is everything where no row has a language.
    Repeated rows are predicted each; an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", 3) == 1
    model = train(docs.filter(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")), model)

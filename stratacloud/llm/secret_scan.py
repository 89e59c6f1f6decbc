"""Secret scan: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Every run of 16 or more characters of the base-64 alphabets that could hold a secret is a candidate. The narrowest
encoding that its characters allow is inferred (hex, letters of one case with digits, alphanumeric, base 64), and tests
compare it with a uniform draw from that alphabet:

* chi-squared uniformity over the single characters, and over cells of the alphabet, on both sides: too even is not
  random either,
* runs above and below the alphabet's middle (Wald-Wolfowitz),
* lag-1 serial correlation of the characters' places in the alphabet.

Letters stand in the alphabet by their frequency in English, so that cells and middle part common letters from rare ones.
The p-values are combined (Fisher). Natural runs fail the battery, so what has to be controlled is the number of natural
runs that pass by chance. The null is the battery's own distribution over natural runs of the encoding (words joined by
case, signs and numbers), drawn with a fixed seed at several lengths. Its logarithm is normal, with moments that go
straight between these lengths; a candidate's p-value is the lower tail, at its own length, of the likeliest form. The share of natural runs among
the candidates of a class is estimated from those with p-values above a half, and the threshold is the highest at which
that share times the p-value, over the share of candidates passed, is within the rate (Storey's form of
Benjamini-Hochberg). It is found from a histogram of fixed size over all candidates of the corpus, per encoding and class
of lengths; no count switches anything. What is itself unlikely as a uniform draw (1 in 1000) is not reported.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm._shared import bounded, read_table

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_HINT = re.compile(r"(?ai)passw|secret|token|api_?key")
LEAST_BITS = 64
#: Upper ends of the classes of lengths.
LENGTHS = (20, 24, 32, 48, 1 << 30)
BINS = 256
FALSE_DISCOVERIES = 0.01
#: The combined statistic that a uniform draw exceeds once in about 1000 times (simulated, over all encodings and lengths).
RANDOM_ENOUGH = 34.0
#: Letters by frequency in English, in hundredths of a percent.
_LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (1270, 906, 817, 751, 697, 675, 633, 609, 599, 425, 403, 278, 276, 241, 236, 223, 202, 197, 193, 149, 98, 77, 15, 15, 10, 7)))

_DIGITS, _COMMON, _RARE = "0123456789", "etaoinshrdlcu", "mwfgypbvkjxqz"
#: Alphabets as cells; the order of characters is that of their places.
ALPHABETS = {
    "hex": ["0123", "4567", "89ab", "cdef"],
    "HEX": ["0123", "4567", "89AB", "CDEF"],
    "lower": [_COMMON, _DIGITS, _RARE],
    "upper": [_COMMON.upper(), _DIGITS, _RARE.upper()],
    "alnum": [_COMMON, _COMMON.upper(), _DIGITS, _RARE, _RARE.upper()],
    "base64": [_COMMON, _COMMON.upper(), _DIGITS + "+/-_", _RARE, _RARE.upper()],
}
ENCODINGS = tuple(ALPHABETS)
_PLACES = {name: {c: (i, j) for j, (i, c) in enumerate((i, c) for i, cell in enumerate(cells) for c in cell)} for name, cells in ALPHABETS.items()}
_WIDTHS = {name: [len(cell) for cell in cells] for name, cells in ALPHABETS.items()}


def encoding(run: str) -> str:
    """The narrowest alphabet that holds the run, its padding aside."""
    chars = set(run) - {"="}
    return next((name for name in ENCODINGS if chars <= _PLACES[name].keys()), "base64")


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _both_tails(x: float, mean: float, variance: float) -> float:
    """Of a sum of squares with this mean and variance, as a scaled chi-squared by the Wilson-Hilferty approximation."""
    df = 2 * mean * mean / variance
    z = ((max(x, 1e-9) / mean) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return min(1.0, _tail(z))


def battery(run: str) -> float:
    """Evidence against a uniform draw: Fisher's -2 sum(log p) of the tests (about 7 where random, large if not)."""
    name = encoding(run)
    places, widths = _PLACES[name], _WIDTHS[name]
    size, at = sum(widths), [places[c] for c in run if c in places]
    n = len(at)
    if n < 8:
        return 200.0
    cells, single = [0] * len(widths), {}
    for cell, place in at:
        cells[cell] += 1
        single[place] = single.get(place, 0) + 1
    x = size / n * sum(k * k for k in single.values()) - n
    p0 = _both_tails(x, size - 1, 2 * (size - 1) * (n - 1) / n)
    chi = sum((k - n * w / size) ** 2 / (n * w / size) for k, w in zip(cells, widths))
    p1 = _both_tails(chi, len(widths) - 1, 2 * (len(widths) - 1))
    order = [place for _, place in at]
    high = [place * 2 >= size for place in order]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / max(n - 1, 1)
        p2 = _tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p2 = 2.0 ** (1 - n)
    m = sum(order) / n
    v = sum((p - m) ** 2 for p in order)
    r = sum((x - m) * (y - m) for x, y in zip(order, order[1:])) / v if v else 1.0
    p3 = _tail((r + 1 / n) * math.sqrt(n))
    return -2 * sum(math.log(max(p, 1e-30)) for p in (p0, p1, p2, p3))


def bits(run: str) -> float:
    """Bits that a uniform draw of this length and encoding holds."""
    return len(run.rstrip("=")) * math.log2(sum(_WIDTHS[encoding(run)]))


def length_class(n: int) -> int:
    return next(i for i, top in enumerate(LENGTHS) if n <= top)


def run_class(run: str) -> int:
    """Number of the encoding and class of lengths."""
    return ENCODINGS.index(encoding(run)) * len(LENGTHS) + length_class(len(run))


def p_bin(p: float) -> int:
    """Eight bins per decade; the smallest p-values in the last bin."""
    return min(int(-8 * math.log10(max(p, 1e-300))), BINS - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def _mixed(run: str) -> bool:
    """64 bits or more, and digits beside letters or both cases within. Words lack that, and numbers alone: an account number is as random as a secret."""
    if bits(run) < LEAST_BITS:
        return False
    digits = any(c.isdigit() for c in run)
    letters = any(c.isalpha() for c in run)
    inner = run[1:]
    return (digits and letters) or (any(c.isupper() for c in inner) and any(c.islower() for c in inner))


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, run) of the runs that no fixed span touches. Both come in order, so one pass does."""
    at, spans = 0, sorted((s, e) for s, _, e in base)
    reach = 0  # the furthest end of the spans that start before the run's end
    for m in _RUN.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start() and _mixed(m[0]):
            yield m.start(), m.end(), m[0]


def histogram(runs: Iterable[str], moments: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Candidates by class and bin of p-values."""
    counts = np.zeros((len(ENCODINGS) * len(LENGTHS), BINS), np.int64)
    for run in runs:
        counts[run_class(run), p_bin(p_value(run, battery(run), moments))] += 1
    return counts


def _counted(moments: dict[str, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (text for batch in batches for text in batch.column(0).to_pylist() if text and _RUN.search(text))
        counts = histogram((r for text in texts for _, _, r in candidates(text, base_spans(text))), moments)
        class_, bin_ = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (class_, bin_, counts[class_, bin_])], names=["class", "bin", "n"])

    return bounded(run)


def natural_run(form: str, n: int, rng: random.Random) -> str:
    """What people write without blanks: words joined by case, by a sign (some of them numbers), or by nothing around one number."""
    letters, often = ("abcdef", (817, 149, 278, 425, 1270, 223)) if form == "hex" else (list(_LETTERS), list(_LETTERS.values()))
    words = []
    while sum(map(len, words)) < n:
        words.append("".join(rng.choices(letters, often, k=rng.randrange(2, 10))))
    number = lambda: str(rng.choice((rng.randrange(1900, 2100), rng.randrange(100), rng.randrange(3000))))
    if form == "signs":
        words = [number() if rng.random() < 0.2 else w.capitalize() if rng.random() < 0.2 else w for w in words]
        out = rng.choice("_/-").join(words)
    else:
        words.insert(rng.randrange(len(words) + 1), number())
        out = "".join(words[:1] + [w.capitalize() for w in words[1:]] if form == "case" else words)
    at = rng.randrange(max(len(out) - n, 0) + 1) if form == "hex" else 0
    return out[at : at + n]


#: The form of natural runs that falls into each encoding; the other case looks the same to the battery.
FORMS = {"hex": "hex", "HEX": "hex", "lower": "plain", "upper": "plain", "alnum": "case", "base64": "signs"}
#: Lengths at which the null is drawn.
_DRAWN_AT = (16, 20, 24, 32, 40, 64, 96)


@functools.cache
def null_moments(draws: int = 700) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per form of natural runs the mean and deviation of the logarithm of the battery, by length. The driver draws them once."""
    rng = random.Random(7)
    out = {}
    for form in sorted(set(FORMS.values())):
        moments = []
        for n in _DRAWN_AT:
            runs: list[str] = []
            while len(runs) < draws:
                run = natural_run(form, n, rng)
                if _mixed(run) or form == "hex":
                    runs.append(run)
            x = np.log([battery(r) for r in runs])
            moments.append((x.mean(), x.std()))
        out[form] = tuple(np.array(m) for m in zip(*moments))
    return out


def p_value(run: str, x: float, moments: dict[str, tuple[np.ndarray, np.ndarray]]) -> float:
    """How likely a natural run of this length and encoding looks as random as x or more."""
    mean, sd = (float(np.interp(len(run), _DRAWN_AT, m)) for m in moments[FORMS[encoding(run)]])
    return 0.5 * math.erfc((mean - math.log(max(x, 1e-9))) / sd / math.sqrt(2))


@dataclass(frozen=True)
class Control:
    """The null, and per class the first bin of p-values that is accepted (BINS where none is)."""

    moments: dict[str, tuple[np.ndarray, np.ndarray]]
    limits: tuple[int, ...]

    def accepts(self, run: str) -> bool:
        x = battery(run)
        return x <= RANDOM_ENOUGH and p_bin(p_value(run, x, self.moments)) >= self.limits[run_class(run)]


def control(found: np.ndarray, rate: float = FALSE_DISCOVERIES) -> Control:
    """From the histogram of all candidates by class and bin of p-values."""
    least = 10.0 ** (-np.arange(BINS) / 8)  # the upper end of each bin
    limits = []
    for h in found:
        natural = min(2 * (h[least > 0.5].sum() + 1), h.sum())  # Storey's estimate, never below two
        passed = np.cumsum(h[::-1])[::-1]
        good = np.flatnonzero((h > 0) & (least * natural <= rate * passed))
        limits.append(int(good.min()) if len(good) else BINS)
    return Control(null_moments(), tuple(limits))


def scan(text: str | None, limits: Control) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the fixed patterns, and those that the battery adds where no fixed span lies."""
    text = text or ""
    base = base_spans(text)
    return base, [(s, 3, e) for s, e, run in candidates(text, base) if limits.accepts(run)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def fit(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> Control:
    """The thresholds that all texts of ``docs`` give together."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(null_moments()), "class long, bin long, n long").groupBy("class", "bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(ENCODINGS) * len(LENGTHS), BINS), np.int64)
    for r in rows:
        counts[r["class"], r["bin"]] = r["n"]
    return control(counts, rate)


def _scanned(limits: Control):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, texts = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                base, more = scan(text, limits)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(base + more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return bounded(run)


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row. Null texts are empty; repeated rows count each."""
    limits = fit(docs, rate)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scanned(limits), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its numbers of fixed matches and all its spans."""
    return find_secrets(read_table(spark, sf_dir, "documents"))


def redact(text: str, limits: Control, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    base, more = scan(text, limits)
    for s, e in sorted((s, e) for s, _, e in base + more):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _redacted(limits: Control):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = [t if t is None else redact(t, limits) for t in batch.column(k).to_pylist()]
            columns = list(batch.columns)
            columns[k] = pa.array(texts, pa.string())
            if (c := batch.schema.get_field_index("n_chars")) >= 0:
                columns[c] = pa.array([old if new is None else len(new) for old, new in zip(batch.column(c).to_pylist(), texts)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return bounded(run)


def secrets_stage(docs: DataFrame) -> DataFrame:
    """All documents with their secrets replaced by a mark; n_chars is counted anew."""
    limits = fit(docs)
    typed = docs.select(*[F.col(c).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
    return typed.mapInArrow(_redacted(limits), typed.schema)

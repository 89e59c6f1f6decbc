"""Document quality by hierarchical empirical Bayes.

A logistic model over text statistics, fitted on a bounded sample of labelled rows, gives each document's own evidence.
Sites are counted over all documents in two levels, host and path: the documents' own scores, and the labels there are.
The prior's strength of each level comes from the data (method of moments: how much more sites differ than sampling
explains), so that sparse sites shrink towards their host, and sparse hosts towards the whole corpus. A document's
posterior adds the log odds of its path (without the document's own share, against the whole corpus) to its own, with the
weight that explains the labels of the sample best; there own evidence comes from a model that has not seen the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm._shared import Scratch, bounded, column_bytes, join_counted, pieces_of, read_table
from stratacloud.llm._text import PIECE_BYTES, Rolling, lower, words

#: Labelled rows that the document model is fitted on, taken in the order of a hash of their ids.
TRAINING_ROWS = 4000
FOLDS = 4

_UPPER, _LOWERCASE, _DIGIT, _MARK, _ODD, _HIGH, _LINE = range(7)
_KIND = np.full(256, 7, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:], _KIND[10] = _UPPER, _LOWERCASE, _DIGIT, _HIGH, _LINE
_KIND[list(b".,;:?'\"()-")] = _MARK
_KIND[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = _ODD
N_FEATURES = 18


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row a vector of text statistics, all ratios or logs, and its number of words."""
    n = len(offs) - 1
    length = np.diff(offs)
    kinds = _KIND[data]
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    for k in range(7):
        sums = np.concatenate(([0], np.cumsum(kinds == k)))
        x[:, 1 + k] = (sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(length, 1)
    low = lower(data)
    starts, ends, at = words(low, offs)
    h = Rolling(low).of(starts, ends)
    same = np.concatenate(([0], np.cumsum(np.concatenate(([False], h[1:] == h[:-1])))))
    odd = np.concatenate(([0], np.cumsum(_KIND[data[ends - 1]] == _ODD)))
    shift = np.concatenate(([0], np.cumsum(_KIND[data[starts]] == _UPPER)))
    bars = np.concatenate(([0], np.cumsum((ends - starts == 1) & (_KIND[data[starts]] == _ODD))))
    count = np.diff(at)
    safe = np.maximum(count, 1)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            _, times = np.unique(h[a:b], return_counts=True)
            x[i, 8] = np.log(len(times)) - 0.75 * np.log(b - a)
            x[i, 9] = times.max() / (b - a)
            x[i, 10] = np.square(times / (b - a)).sum()
    x[:, 11] = (same[np.maximum(at[1:], at[:-1])] - same[np.minimum(at[:-1] + 1, at[1:])]) / safe
    x[:, 12] = (odd[at[1:]] - odd[at[:-1]]) / safe
    x[:, 13] = (shift[at[1:]] - shift[at[:-1]]) / safe
    x[:, 14] = (bars[at[1:]] - bars[at[:-1]]) / safe
    x[:, 15] = np.log1p(count) / 8
    x[:, 16] = np.minimum(length / safe, 40) / 10
    x[:, 17] = np.log1p(length) / 10
    return x, count


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression over the statistics and their squares: centre, scale and weights."""
    z = np.hstack([x, np.square(x[:, 1:])])
    centre, scale = z.mean(0), z.std(0) + 1e-9
    centre[0], scale[0] = 0, 1
    z = np.clip((z - centre) / scale, -8, 8)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-5)
        step = np.linalg.solve((z * s[:, None]).T @ z + ridge * len(y) * np.eye(len(w)), z.T @ (y - p) - ridge * len(y) * w)
        w += step * min(1, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


def log_odds(x: np.ndarray, model) -> np.ndarray:
    centre, scale, w = model
    z = np.clip((np.hstack([x, np.square(x[:, 1:])]) - centre) / scale, -8, 8)
    return np.clip(z @ w, -12, 12)


@bounded
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = column_bytes(batch.column(0))
        for i, j, part, at in pieces_of(data, offs, PIECE_BYTES):
            x, _ = features(part, at)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *(batch.column(k).slice(i, j - i) for k in (1, 2, 3))], names=["x", "quality", "host", "path"])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("__text")
            data, offs = column_bytes(batch.column(k))
            odds = np.empty(len(offs) - 1)
            for i, j, part, at in pieces_of(data, offs, PIECE_BYTES):
                x, count = features(part, at)
                odds[i:j] = np.where(count > 0, log_odds(x, model) if model else 0.0, -12.0)
            rest = [c for c in range(batch.num_columns) if c != k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(odds)], names=[*(batch.schema.names[c] for c in rest), "__odds"])

    return bounded(run)


@dataclass
class Sample:
    """The labelled rows that are fitted on: statistics, labels and sites."""

    x: np.ndarray
    good: np.ndarray
    sites: list[tuple[str, str]]

    @property
    def usable(self) -> bool:
        return len(set(self.good.tolist())) == 2

    def model(self):
        """The document model; None where the labels hold fewer than two classes."""
        return fit(self.x, self.good) if self.usable else None

    def unseen_odds(self) -> np.ndarray:
        """Log odds of each row by a model that was fitted on the other folds."""
        fold = np.arange(len(self.good)) % FOLDS
        out = np.zeros(len(self.good))
        for k in range(FOLDS):
            rest = fold != k
            if len(set(self.good[rest].tolist())) == 2:
                out[~rest] = log_odds(self.x[~rest], fit(self.x[rest], self.good[rest]))
        return out


def site_weight(odds: np.ndarray, site: np.ndarray, good: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> float:
    """The weight of ``site`` beside ``odds`` in a logistic model of the labels, within 0 and 2; a normal prior at 0 of variance 1 / ridge."""
    w = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(odds + w * site, -30, 30)))
        step = (site @ (good - p) - ridge * w) / ((site * site) @ (p * (1 - p)) + ridge)
        w += float(np.clip(step, -1, 1))
        if abs(step) < 1e-9:
            break
    return float(np.clip(w, 0, 2))


def one_label(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))


def sample(docs: DataFrame, labels: DataFrame, host: Column, path: Column, rows: int = TRAINING_ROWS) -> Sample:
    """At most ``rows`` labelled documents, by a hash of their ids."""
    chosen = one_label(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text"), host.alias("host"), path.alias("path")).join(F.broadcast(chosen.select(F.col("doc_id").alias("l_id"), "good")), F.col("doc_id") == F.col("l_id"))
    got = found.select("text", "good", "host", "path").mapInArrow(_featured, "x array<double>, quality int, host string, path string").collect()
    got.sort(key=lambda r: (r["quality"], r["host"], r["path"], r["x"]))
    return Sample(np.array([r["x"] for r in got]), np.array([float(r["quality"]) for r in got]), [(r["host"], r["path"]) for r in got])


def _strength(frame: DataFrame, mean: Column) -> float:
    """Of a Beta prior over the rates of sites (columns n, good): between-site spread beyond sampling noise."""
    r = frame.select(F.col("n").alias("n"), (F.col("good") / F.col("n")).alias("rate"), mean.alias("m")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("rate") - F.col("m")) ** 2).alias("between"), F.sum(F.col("m") * (1 - F.col("m"))).alias("noise"), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("spread")
    ).first()
    if not r["n"]:
        return 10.0
    excess = (r["between"] - r["noise"]) / max(r["n"], 1)
    return float(np.clip(r["spread"] / r["n"] / excess - 1, 2, 1e6)) if excess > 0 else 1e6


def site_posteriors(scored: DataFrame, labelled: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """(host, path, good, n, key_rows, host_rate, path_rate, strength) per path, and the global rate.

    Over scored rows (host, path, p) and labelled ones (host, path, good); ``key_rows`` counts the scored ones.
    """
    rows = scored.select("host", "path", F.col("p").alias("good"), F.lit(1).alias("own")).unionAll(labelled.select("host", "path", F.col("good").cast("double"), F.lit(0)))
    paths = scratch.save(rows.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"), F.sum("own").alias("key_rows")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good"), F.sum("n")).first()
    rate = (total[0] + 1) / (total[1] + 2) if total[1] else 0.5
    k_host = _strength(hosts, F.lit(rate))
    hosts = hosts.select("host", ((F.col("good") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    both = paths.join(hosts, "host")
    k_path = _strength(both, F.col("host_rate"))
    return both.withColumn("strength", F.lit(k_path)).withColumn("path_rate", (F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)), rate


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: list[str], rows: int = TRAINING_ROWS, prefix: str = "") -> DataFrame:
    """Columns ``keep`` of ``docs`` and doc_score, host_rate, path_rate, score (all 0..1) and accepted, per row.

    ``prefix`` goes before the new names, where ``keep`` may hold them too.

    Text null or without words scores near 0 and is rejected. Null hosts and paths are sites of their own. Repeated
    rows count each; of several labels of a doc_id the least counts. Without usable labels all evidence is even and
    everything with words is accepted. An empty table gives no rows. Texts are parsed once.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    none = F.lit("\0")  # what stands for null in a key
    host, path = F.coalesce(host, none), F.coalesce(path, none)
    seen = sample(docs, labels, host, path, rows)
    model = seen.model()
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    base = docs.select(*kept, F.col("doc_id").cast("long").alias("__id"), host.alias("host"), path.alias("path"), F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.drop("__text").schema.fields)
    every = scratch.save(base.mapInArrow(_scored(model), fields + ", __odds double"), "scored")
    own = 1 / (1 + F.exp(-F.col("__odds")))
    labelled = every.filter("__id is not null").select("__id", "host", "path").join(one_label(labels).withColumnRenamed("doc_id", "__id"), "__id")
    sites, rate = site_posteriors(every.select("host", "path", own.alias("p")), labelled, scratch)
    sites = scratch.save(sites, "sites")
    weight = site_weight(*_site_evidence(seen, sites, rate)) if seen.usable else 0.0
    n = sites.agg(F.coalesce(F.sum("key_rows"), F.lit(0))).first()[0]
    joined = join_counted(every, sites, ["host", "path"], n)
    others = (F.col("good") - own + F.col("strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("strength"))
    others = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("__odds") + weight * (F.log(others / (1 - others)) - F.lit(float(np.log(rate / (1 - rate)))))
    score = 1 / (1 + F.exp(-odds))
    return joined.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], own.alias(f"{prefix}doc_score"), F.col("host_rate").alias(f"{prefix}host_rate"), F.col("path_rate").alias(f"{prefix}path_rate"), score.alias(f"{prefix}score"), (score >= 0.5).alias(f"{prefix}accepted"))


def _site_evidence(seen: Sample, sites: DataFrame, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sample's rows: own log odds unseen, log odds of the path without the row's score and label, and labels."""
    spark = sites.sparkSession
    wanted = spark.createDataFrame(sorted(set(seen.sites)), "host string, path string")
    found = {(r["host"], r["path"]): r for r in sites.join(F.broadcast(wanted), ["host", "path"]).collect()}
    odds = seen.unseen_odds()
    p = 1 / (1 + np.exp(-log_odds(seen.x, seen.model())))
    out = []
    for site, own, label in zip(seen.sites, p, seen.good):
        r = found[site]
        others = (r["good"] - own - label + r["strength"] * r["host_rate"]) / max(r["n"] - 2 + r["strength"], 1e-9)
        others = min(max(others, 1e-6), 1 - 1e-6)
        out.append(np.log(others / (1 - others)) - np.log(rate / (1 - rate)))
    return odds, np.array(out), seen.good


def site_columns() -> tuple[Column, Column]:
    """Host and path of ``documents``: its source up to the first slash, and all of it; without a slash the language stands for the path.

    Of a URL the host is the authority, in lower case, and the path ends before the query or fragment.
    """
    source = F.col("source").cast("string")
    rest = F.regexp_replace(source, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    url = rest != source
    site = F.when(url, F.regexp_extract(rest, r"^[^?#]*", 0)).otherwise(source)
    first = F.substring_index(site, "/", 1)
    host = F.when(url, F.lower(first)).otherwise(first)
    path = F.when(F.instr(site, "/") > 0, F.regexp_replace(site, r"^[^/]*/", "")).otherwise(F.col("lang").cast("string"))
    return host, F.concat_ws("/", host, path)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its own score, its sites' rates, its posterior and whether it is accepted."""
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), *site_columns(), keep=["doc_id", "source", "lang"])


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted documents, columns as they were."""
    names = docs.columns
    return quality(docs, labels, *site_columns(), keep=names, prefix="__q_").filter("__q_accepted").select(*names)

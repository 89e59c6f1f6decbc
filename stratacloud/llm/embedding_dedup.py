"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors with cosine >= 0.98 are at most 0.2 apart. A table hashes a vector with K random Gaussian
projections, each shifted and cut into steps of a width W; vectors that share all K steps meet in a bucket. Pairs that
meet are compared in double precision. With K = 6, W = 1.4 and 20 tables a pair at the limit of 0.2 is missed with a
probability of 2e-6, closer pairs more rarely.

Equal vectors of a label form one class with a multiplicity. Buckets are cut into blocks; each pair of blocks is a
task of bounded size that returns per class the number of its links and a spanning forest, never the pairs. A pair
that meets in several tables counts in the first one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm._shared import Scratch, bounded, n_partitions, read_table
from stratacloud.llm._text import mix
from stratacloud.llm.components import connected_components

TABLES, PROJECTIONS, WIDTH = 20, 6, 1.4
LEAST_COSINE = 0.98
BLOCK = 2048
#: Buckets up to this size are taken many at once, and pairs of them by this number.
SMALL_GROUP, PAIRS = 48, 40_000
_families: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def family(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections and shifts for vectors of a length."""
    if dim not in _families:
        rng = np.random.default_rng([77, dim])
        _families[dim] = rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    return _families[dim]


def buckets(unit: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per vector and table. The sum runs in a fixed order, so a vector gets the same bucket anywhere."""
    a, b = family(unit.shape[1])
    steps = np.floor((np.einsum("nd,dk->nk", unit, a) + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, PROJECTIONS)
    key = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), steps.shape[:2]).copy()
    for j in range(PROJECTIONS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ steps[:, :, j])
    return key.view(np.int64)


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("nd,nd->n", scaled, scaled))[:, None]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(2).to_pylist()
        dims = np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            keys = buckets(units(matrix([vectors[i] for i in at])))
            rep = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False)[at], TABLES))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([rep(0), rep(1), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))), pa.array(keys.reshape(-1))], names=["label", "cid", "tab", "bucket"])


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a table as one flat array and their ends."""
    column = table.column("vector").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(np.diff(column.offsets.to_numpy()))


def united(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Bring the least member of each component to all of its members, in place: p and q are linked pairs."""
    while len(p):
        a, b = root[p], root[q]
        apart = a != b
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _block_links(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One pair of blocks: (class, class, links) with the links that no earlier table has, and (a, b, 0) for each class and the least one of its component here."""
    side, cid, n = (t.column(c).to_numpy() for c in ("side", "cid", "n"))
    tab, same = t.column("tab")[0].as_py(), t.column("i")[0].as_py() == t.column("j")[0].as_py()
    flat, ends = _vectors(t)
    dims = np.diff(np.concatenate(([0], ends)))
    for dim in np.unique(dims):
        left = np.flatnonzero((dims == dim) & (side == 0))
        right = left if same else np.flatnonzero((dims == dim) & (side == 1))
        if not len(left) or not len(right) or (same and len(left) < 2):
            continue
        rows = np.union1d(left, right)
        x = units(flat[(ends[rows, None] - dim) + np.arange(dim)])
        at = np.empty(len(dims), np.int64)
        at[rows] = np.arange(len(rows))
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        y, right_cid = x[at[right]], cid[right]
        for s in range(0, len(left), 256):
            p, q = np.nonzero(x[at[left[s : s + 256]]] @ y.T >= LEAST_COSINE - 1e-9)
            p += s
            keep = cid[left[p]] < right_cid[q] if same else cid[left[p]] != right_cid[q]
            p, q = at[left[p[keep]]], at[right[q[keep]]]
            if not len(p):
                continue
            sure = np.einsum("nd,nd->n", x[p], x[q]) >= LEAST_COSINE
            p, q = p[sure], q[sure]
            fresh = np.ones(len(p), bool)
            if tab and len(p):
                # The tables before this one, of the linked vectors only.
                used, where = np.unique(np.concatenate((p, q)), return_inverse=True)
                keys = buckets(x[used])[:, :tab]
                for k in range(0, len(p), 65_536):
                    fresh[k : k + 65_536] = ~(keys[where[: len(p)][k : k + 65_536]] == keys[where[len(p) :][k : k + 65_536]]).any(axis=1)
            np.add.at(links, p[fresh], n[rows[q[fresh]]])
            np.add.at(links, q[fresh], n[rows[p[fresh]]])
            united(root, p, q)
        some = np.flatnonzero(links)
        yield cid[rows[some]], cid[rows[some]], links[some]
        a = np.flatnonzero(root != np.arange(len(root)))
        if len(a):
            yield cid[rows[a]], cid[rows[root[a]]], np.zeros(len(a), np.int64)


def _small_links(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for many small buckets at once: their pairs side by side, in portions."""
    size = ends - starts
    row = np.repeat(starts, size) + _counting(size)
    partners = np.repeat(ends, size) - 1 - row
    cid, n, tab = (t.column(c).to_numpy() for c in ("cid", "n", "tab"))
    flat, stops = _vectors(t)
    dims = np.diff(np.concatenate(([0], stops)))
    links, root, keys = np.zeros(len(cid), np.int64), np.arange(len(cid)), {}
    x, at = {}, np.zeros(len(cid), np.int64)
    for dim in np.unique(dims[row]):
        own = row[dims[row] == dim]
        x[dim], at[own] = units(flat[(stops[own, None] - dim) + np.arange(dim)]), np.arange(len(own))
    cuts = np.searchsorted(np.cumsum(partners), np.arange(PAIRS, int(partners.sum()) + PAIRS, PAIRS), side="left") + 1
    for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
        k = partners[i:j]
        p = np.repeat(row[i:j], k)
        q = p + 1 + _counting(k)
        for dim in x:
            same = (dims[p] == dim) & (dims[q] == dim)
            a, b = p[same], q[same]
            sure = np.einsum("nd,nd->n", x[dim][at[a]], x[dim][at[b]]) >= LEAST_COSINE
            a, b = a[sure], b[sure]
            if not len(a):
                continue
            if dim not in keys:
                keys[dim] = buckets(x[dim])
            # Pairs that met in a table before this one are counted there.
            met = (keys[dim][at[a]] == keys[dim][at[b]]) & (np.arange(TABLES) < tab[a][:, None])
            fresh = ~met.any(axis=1)
            np.add.at(links, a[fresh], n[b[fresh]])
            np.add.at(links, b[fresh], n[a[fresh]])
            united(root, a, b)
    some, apart = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
    yield cid[some], cid[some], links[some]
    yield cid[apart], cid[root[apart]], np.zeros(len(apart), np.int64)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


_GROUP = ("tab", "bucket", "label", "i", "j")


@bounded
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by bucket and pair of blocks; only the last group waits for the next batch."""

    def found(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        columns = [t.column(c).to_numpy() for c in _GROUP]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [t.num_rows]))
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        small = (ends - starts <= SMALL_GROUP) & (columns[3][starts] == columns[4][starts])
        if small.any():
            held += _small_links(t, starts[small], ends[small])
        for a, b in zip(starts[~small].tolist(), ends[~small].tolist()):
            held += _block_links(t.slice(a, b - a).combine_chunks())
        rest = t.slice(int(ends[-1]) if len(ends) else 0).combine_chunks()
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held)], names=["a", "b", "links"]) if held else None
        return out, rest

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        out, rest = found(pa.concat_tables([rest, t]).combine_chunks() if rest is not None and rest.num_rows else t.combine_chunks(), False)
        if out is not None:
            yield out
    if rest is not None and rest.num_rows:
        out, _ = found(rest, True)
        if out is not None:
            yield out


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine is 0.98 or more. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, and neither do vectors of different lengths.
    Repeated rows are vectors of their own and link like copies; an id that names several vectors is one vertex. A row
    without vec_id links with nothing and has no component. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pstable")
    v = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    good = rows.filter(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("cid", F.xxhash64("label", "vector"))
    classes = scratch.save(classes, "classes")
    keyed = scratch.save(classes.select("label", "cid", "vector").mapInArrow(_hashed, "label long, cid long, tab int, bucket long"), "keys")
    key = ["label", "tab", "bucket"]
    shared = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(*key, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    met = keyed.join(shared, key).join(classes.select("cid", "n", "vector"), "cid")
    block = F.pmod(F.xxhash64("cid", F.lit(3)), F.col("blocks")).cast("int")
    # A row of block x stands on the left of the pairs (x, j >= x) and on the right of (i < x, x).
    turns = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, block).alias("i"), F.greatest(o, block).alias("j"), F.when(o >= block, 0).otherwise(1).alias("side")))
    dealt = met.withColumn("turn", F.explode(turns)).select(*key, F.col("turn.i").alias("i"), F.col("turn.j").alias("j"), F.col("turn.side").alias("side"), "cid", "n", "vector")
    # The groups lie sorted in their partitions and are read one after the other.
    order = ["tab", "bucket", "label", "i", "j"]
    dealt = dealt.repartition(n_partitions(spark), *order).sortWithinPartitions(*order)
    found = scratch.save(dealt.mapInArrow(_linked, "a long, b long, links long"), "links")
    links = found.filter("links > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    member = good.join(classes.select("label", "vector", "rep", "cid", "n"), ["label", "vector"]).select("vec_id", "rep", "cid", "n")
    member = scratch.save(member, "members")
    rep = classes.select("cid", "rep")
    edges = found.filter("links = 0").join(rep.toDF("a", "rep_a"), "a").join(rep.toDF("b", "rep_b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    comps = connected_components(edges.unionAll(member.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()), scratch)
    counted = member.join(links, "cid", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    rest = rows.filter(~F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    every = counted.unionAll(rest).join(comps, F.col("vec_id") == F.col("id"), "left")
    comp = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", "n_links", comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links, its component and whether it stays."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY id) c ON c.id = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
"""

"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit ring give all coordinates of a signature: ``sigma`` (the fingerprint's own bits) places
a shingle on the ring, the ring is shifted by k equal steps, and ``pi`` (one fixed bijection) is applied; coordinate k
is the least value over the set. Bands of coordinates are the blocking keys; every link is confirmed on full sets.

With J = 0.75 a pair misses all 32 bands of 4 with a probability of 5e-6.

Copies are not expanded. Documents with equal sets form a class, each class is one vertex. In a bucket every class is
first compared with the least one; where that leaves a bucket in several components, the classes outside its largest
component (strays) are compared with all others by their signatures, and then on full sets with all members of each
component that holds a likely partner. So no link between different sets is lost, a group of n near copies costs about n
comparisons, and neither pairs nor groups grow beyond blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm._shared import Scratch, binary_array, bounded, column_bytes, grouped, join_counted, light_partitions, n_partitions, pieces_of, read_table
from stratacloud.llm._text import PIECE_BYTES, mix, shingles
from stratacloud.llm.components import connected_components

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Classes that one block of a bucket compares with another.
BLOCK = 2048
#: Members of a component that a stray is compared with at once.
MEMBER_BLOCK = 512
#: Coordinates that must agree before full sets are compared: at J = 0.75 96 of 128 are expected, and fewer than 74 come with a probability of 4e-6.
LEAST_AGREEING = 74

_STEPS = (np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64((1 << 32) // COORDINATES)).astype(np.uint32)


def _pi(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words, in place."""
    for factor, shift in ((0x7FEB352D, 15), (0x846CA68B, 16)):
        x *= np.uint32(factor)
        x ^= x >> np.uint32(shift)
    return x


def signature(members: np.ndarray) -> np.ndarray:
    """All coordinates of a set of 64-bit fingerprints."""
    place = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(place), 256):
        block = place[i : i + 256, None] + _STEPS
        np.minimum(least, _pi(block).min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    s = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key ^ (s[:, :, j] + np.uint64(j)))
    return key.view(np.int64)


@bounded
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, (data, offs) = batch.column(0), column_bytes(batch.column(1))
        for i, j, part, at in pieces_of(data, offs, PIECE_BYTES):
            sets = shingles(part, at)
            n = np.array([len(s) for s in sets], np.int64)
            one = np.array([int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            two = np.array([int(mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            sig = np.stack([signature(s) for s in sets])
            keys = np.ascontiguousarray(band_keys(sig)).view(np.uint8).reshape(-1)
            low = np.ascontiguousarray(sig.astype(np.uint8)).reshape(-1)
            rows = np.arange(j - i + 1)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i).cast(pa.int64()), pa.array(n), pa.array(one), pa.array(two), binary_array(low, rows * COORDINATES), binary_array(keys, rows * BANDS * 8)],
                names=["doc_id", "n_shingles", "set_1", "set_2", "low", "bands"],
            )


@bounded
def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = column_bytes(batch.column(2))[0].view(np.int64)
        cid, n = np.repeat(batch.column(0).to_numpy(), BANDS), np.repeat(batch.column(1).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cid), pa.array(n)], names=["bucket", "cid", "n"])


def _verified(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for batch in batches:
            a_id, b_id = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (a, ao), (b, bo) = column_bytes(batch.column(2)), column_bytes(batch.column(3))
            good = np.zeros(len(a_id), bool)
            for i, j, part, at in pieces_of(a, ao, PIECE_BYTES):
                for k, mine in enumerate(shingles(part, at), i):
                    text = b[bo[k] : bo[k + 1]]
                    if last_id != (b_id[k], len(text)):
                        last_id, last = (b_id[k], len(text)), shingles(text, np.array([0, len(text)]))[0]
                    least, most = sorted((len(mine), len(last)))
                    if least and denominator * least >= numerator * most:
                        shared = len(mine) + len(last) - len(np.union1d(mine, last))
                        good[k] = denominator * shared >= numerator * (len(mine) + len(last) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a_id[good]), pa.array(b_id[good])], names=["a", "b"])

    return bounded(run)


def _verify(pairs: DataFrame, texts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Of the pairs (a, b, blocks) those whose full sets are similar enough.

    The hot side, b, is dealt over its blocks, each with one copy of its text; it comes sorted and is parsed once.
    """
    salted = pairs.groupBy("a", "b").agg(F.max("blocks").alias("blocks")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("salt"))
    right = salted.select("b", "salt").distinct().join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    left = salted.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    return left.join(right, ["b", "salt"]).select("a", "b", "a_text", "b_text").mapInArrow(_verified(*similarity), "a long, b long")


def _stray_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of a bucket: each stray with the other components that hold a class whose signature agrees enough."""
    for t in grouped(batches, ["bucket", "i", "j"]):
        stray = t.column("is_stray").to_numpy()
        if not stray.any() or stray.all():
            continue
        cid, comp, n = (t.column(c).to_numpy() for c in ("cid", "comp", "n"))
        low = column_bytes(t.column("low"))[0].reshape(-1, COORDINATES)
        o, out = np.flatnonzero(~stray), set()
        for k in np.flatnonzero(stray).tolist():
            may = o[(comp[o] != comp[k]) & (4 * np.minimum(n[o], n[k]) >= 3 * np.maximum(n[o], n[k]))]
            if len(may):
                may = may[(low[may] == low[k]).sum(axis=1) >= LEAST_AGREEING]
                out.update((int(cid[k]), c) for c in np.unique(comp[may]).tolist())
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["stray", "comp"])


def _stray_links(numerator: int, denominator: int):
    """Per block of a component: a link of each stray to a member, if there is any. Exact, by counting shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["comp", "block"]):
            stray, cid = t.column("is_stray").to_numpy(), t.column("cid").to_numpy()
            sets = [s for _, _, part, at in pieces_of(*column_bytes(t.column("text")), PIECE_BYTES) for s in shingles(part, at)]
            members, strays = np.flatnonzero(~stray).tolist(), np.flatnonzero(stray).tolist()
            if not members or not strays:
                continue
            sizes = np.array([len(sets[m]) for m in members])
            owner = np.repeat(np.arange(len(members)), sizes)
            every = np.concatenate([sets[m] for m in members])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            a, b = [], []
            for k in strays:
                lo, hi = np.searchsorted(every, sets[k], "left"), np.searchsorted(every, sets[k], "right")
                span = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
                shared = np.bincount(owner[at], minlength=len(members))
                good = np.flatnonzero((shared > 0) & (denominator * shared >= numerator * (sizes + len(sets[k]) - shared)))
                if len(good):
                    a.append(int(cid[k]))
                    b.append(int(cid[members[good[0]]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return bounded(run)


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (75, 100), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Similarity is numerator and denominator of the least Jaccard similarity, of 0.75 or more. Null and empty texts have
    no shingles and link with nothing. A doc_id is one vertex: its repeated rows share a component, each row is
    returned. A row without doc_id is its own component (null) and kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    if 4 * similarity[0] < 3 * similarity[1]:
        raise ValueError("bands are laid out for similarities of 0.75 or more")
    scratch = scratch or Scratch(spark, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = texts.mapInArrow(_signed, "doc_id long, n_shingles long, set_1 long, set_2 long, low binary, bands binary")
    signed = scratch.save(signed, "signed")
    sets = signed.filter("n_shingles > 0 and doc_id is not null")
    # Classes of equal sets; the least id stands for each.
    equal = ["set_1", "set_2", "n_shingles"]
    classes = scratch.save(sets.groupBy(*equal).agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("key_rows")), "classes", partitions=light_partitions(signed.count()))
    n_sets, n_classes = classes.agg(F.coalesce(F.sum("key_rows"), F.lit(0)), F.count(F.lit(1))).first()
    member = join_counted(sets.select("doc_id", *equal), classes, equal, n_sets).filter("doc_id <> cid").select(F.col("doc_id").alias("a"), F.col("cid").alias("b")).distinct()
    member = scratch.save(member, "members", partitions=light_partitions(n_sets))
    # An id that stands for its own class carries that class's bands; others of its rows follow by identity.
    heads = sets.select("doc_id", "n_shingles", "low", "bands").join(member.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_anti").unionAll(
        sets.select("doc_id", "n_shingles", "low", "bands").join(classes.groupBy("cid").count().filter("count > 1").select(F.col("cid").alias("doc_id")), "doc_id", "left_semi")
    )
    banded = heads.select(F.col("doc_id").alias("cid"), F.col("n_shingles").alias("n"), "bands").mapInArrow(_banded, "bucket long, cid long, n long")
    lead = banded.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("lead"), F.max("cid").alias("last"), F.count(F.lit(1)).alias("key_rows")).filter("last > lead.cid")
    lead = scratch.save(lead.select("bucket", F.col("lead.cid").alias("lead"), F.col("lead.n").alias("lead_n"), "key_rows"), "leads", partitions=light_partitions(BANDS * n_classes))
    shared = scratch.save(join_counted(banded, lead, ["bucket"], BANDS * n_classes), "buckets", partitions=light_partitions(BANDS * n_classes))
    pairs = shared.filter("cid <> lead and 4 * least(n, lead_n) >= 3 * greatest(n, lead_n)").select(F.col("cid").alias("a"), F.col("lead").alias("b"), F.ceil(F.col("key_rows") / MEMBER_BLOCK).alias("blocks"))
    first = scratch.save(_verify(pairs, texts, similarity), "links")
    # Links and memberships together are no more than bands of all documents.
    most = BANDS * n_sets
    comps = connected_components(first.unionAll(member), scratch, most=most)
    comps = scratch.save(comps, "first", partitions=light_partitions(n_classes))
    # Buckets that still hold several components: strays against all others of the bucket, in blocks.
    seen = shared.select("bucket", "cid", "n").distinct().join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("component_id", "cid"))
    per = seen.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = per.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("size").alias("all")).filter("comps > 1")
    open_ = seen.join(main, "bucket").select("bucket", "cid", "n", "comp", (F.col("comp") != F.col("top.comp")).alias("stray"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("stray_blocks"))
    open_ = scratch.save(open_, "open", partitions=light_partitions(BANDS * n_classes))
    lows = heads.join(open_.select(F.col("cid").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("cid")).agg(F.min("low").alias("low"))
    open_ = open_.join(lows, "cid")
    h, zero, parts = F.xxhash64("cid"), F.lit(0), n_partitions(spark)
    whole = lambda c: F.col(c).cast("int").alias(c)
    as_stray = open_.filter("stray").select("bucket", F.pmod(h, F.col("stray_blocks")).cast("int").alias("i"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("j"), "cid", "n", "comp", "low", F.lit(True).alias("is_stray"))
    as_other = open_.select("bucket", F.explode(F.sequence(zero, F.col("stray_blocks") - 1)).alias("i"), F.pmod(h, F.col("blocks")).cast("int").alias("j"), "cid", "n", "comp", "low", F.lit(False).alias("is_stray"))
    key = ["bucket", "i", "j"]
    cross = as_stray.unionAll(as_other).repartition(parts, *key).sortWithinPartitions(*key)
    asked = scratch.save(cross.mapInArrow(_stray_components, "stray long, comp long").distinct(), "asked")
    # Each stray against all members of the component, in blocks: members come once, strays once per block.
    sizes = asked.select("comp").distinct().join(heads.select(F.col("doc_id").alias("cid")).distinct().join(comps.withColumnRenamed("id", "cid"), "cid", "left").select("cid", F.coalesce("component_id", "cid").alias("comp")), "comp")
    sizes = scratch.save(sizes, "asked_members", partitions=light_partitions(n_classes))
    blocks = sizes.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("blocks"))
    ask = asked.join(blocks, "comp").select("comp", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.col("stray").alias("cid"), F.lit(True).alias("is_stray"))
    held = sizes.join(blocks, "comp").select("comp", F.pmod(h, F.col("blocks")).cast("int").alias("block"), "cid", F.lit(False).alias("is_stray"))
    met = ask.unionAll(held).join(texts.withColumnRenamed("doc_id", "cid"), "cid").select("comp", whole("block"), "cid", "is_stray", "text")
    met = met.repartition(parts, "comp", "block").sortWithinPartitions("comp", "block")
    second = scratch.save(met.mapInArrow(_stray_links(*similarity), "a long, b long"), "links")
    final = connected_components(second.unionAll(comps.select(F.col("id").alias("a"), F.col("component_id").alias("b"))), scratch, most=most)
    comp = F.coalesce("component_id", "doc_id")
    return signed.join(final.withColumnRenamed("id", "vertex"), F.col("doc_id") == F.col("vertex"), "left").select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set, its component and whether it stays."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)
), r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def minhash_stage(docs: DataFrame) -> DataFrame:
    """One document of each group stays, with its columns; of different rows of one doc_id that with the least hash.

    Rows without doc_id stay.
    """
    kept = near_duplicates(docs).filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__kept_id")).agg(F.count(F.lit(1)).alias("__kept_rows"))
    joined = docs.join(kept, docs["doc_id"].cast("long") == F.col("__kept_id"))
    names = docs.columns
    once = joined.filter("__kept_rows = 1").select(*names)
    # Ids with several rows: the least hash by id, then one of the rows that have it, which are alike.
    many = joined.filter("__kept_rows > 1").withColumn("__row_hash", F.xxhash64(*[F.col(c) for c in names]))
    least = many.groupBy(F.col("__kept_id").alias("__least_id")).agg(F.min("__row_hash").alias("__least_hash"))
    picked = many.join(least, (F.col("__kept_id") == F.col("__least_id")) & (F.col("__row_hash") == F.col("__least_hash"))).dropDuplicates(["__kept_id"])
    return once.unionByName(picked.select(*names)).unionByName(docs.filter(F.col("doc_id").isNull()))

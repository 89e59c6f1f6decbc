"""Mix sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / source size. Documents are laid on a
line in the order of their sizes (then of a digest of their ids), the expected copies are summed up along it, one random offset per
source is added, and a document is taken once for each integer boundary that its stretch crosses. Order by size makes
the sample stratified: a source's taken words differ from its target by about one long document at most.

No window holds a whole source. Ranks are made of three bounded parts: counts of the smaller sizes of the source,
counts of the earlier hash cells of that size, and the rank within the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacloud.llm._shared import Scratch, read_table

MOST_COPIES = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: int = 3, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) to these and ``target``: weights 1..``weights`` by turns in order of code points, null last.

    Targets share the sum of all sizes. None exceeds ``most`` times its source; the excess goes to the others by weight.
    The level at which that balances is found by prefix sums over the sources in the order of their caps. One row per
    source is all that a task sees. A source without words has the target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    x = sizes.withColumn("w", ((F.row_number().over(order) - 1) % weights + 1).cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    every = Window.partitionBy(F.lit(1))
    total, weight = F.sum(F.col("source_size").cast("double")).over(every), F.sum("w").over(every)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("level", (total - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / (weight - F.coalesce(F.sum("w").over(by_cap), F.lit(0.0))))
    # The first source whose cap is not below its level sets the level for all after it.
    x = x.withColumn("held", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every).getField("level"))
    return x.select("source", "source_size", F.least("cap", F.coalesce(F.col("held") * F.col("w"), F.col("cap"))).alias("target"))


def _digest(seed: int, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("null"))).cast("binary"))


def mix_sources(docs: DataFrame, seed: int = 17, weights: int = 3, most: int = MOST_COPIES) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source) as (doc_id, source, size, source_size, target, copies, mix_row).

    ``copies`` says how often the mix takes the row. Null texts have size 0; null sources form one source, last in
    order. Rows that repeat count each for itself (``mix_row`` tells them apart only within equal rows). An empty table
    gives no rows. Reruns agree: order and offset come from digests of ids, sources and ``seed``.
    """
    x = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    # Texts are read once; everything after is about ids and sizes.
    x = Scratch(docs.sparkSession, "mixing").save(x, "sizes")
    # The first digits of the digest are the cell, so that cells and ranks within them follow one order: 256 cells a size.
    x = x.withColumn("digest", _digest(seed, F.col("doc_id"))).withColumn("cell", F.substring("digest", 1, 2))
    cells = x.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    per_source = targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    up = Window.unboundedPreceding
    before_size = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(up, -1)), F.lit(0))
    before_cell = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("cell").rowsBetween(up, -1)), F.lit(0))
    s, c, t = sizes.select(F.col("source").alias("s_source"), F.col("size").alias("s_size"), before_size.alias("before_size")), cells.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("cell").alias("c_cell"), before_cell.alias("before_cell")), per_source.withColumnRenamed("source", "t_source")
    at = c.join(s, F.col("c_source").eqNullSafe(F.col("s_source")) & (F.col("c_size") == F.col("s_size"))).join(t, F.col("c_source").eqNullSafe(F.col("t_source")))
    at = at.select("c_source", "c_size", "c_cell", (F.col("before_size") + F.col("before_cell")).alias("before"), "source_size", "target")
    in_cell = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("digest")) - 1
    x = x.withColumn("mix_row", in_cell).join(at, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("cell") == F.col("c_cell")))
    # 1 keeps the place on the line exact: rank and copies stay apart until one product of each.
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    offset = F.conv(F.substring(_digest(seed, F.col("source")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rank = F.col("before") + F.col("mix_row")
    copies = F.least(F.floor(offset + (rank + 1) * each) - F.floor(offset + rank * each), F.lit(most))
    return x.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), "mix_row")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes from it."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT *, CAST(source_size * 3 AS DOUBLE) AS cap, sum(CAST(source_size AS DOUBLE)) OVER () AS total, sum(w) OVER () AS weight FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (weight - coalesce(sum(w) OVER b, 0)) AS level FROM c WINDOW b AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT min_by(level, cap / w) FROM l WHERE cap >= level * w) * w, cap)) AS target FROM l),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) - 1 AS k,
  CAST('0x' || substr(md5('17:' || coalesce(source, 'null')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS o FROM d),
e AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS each FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(o + (k + 1) * each) - floor(o + k * each), 3) AS BIGINT) * size AS taken, source, CAST(least(floor(o + (k + 1) * each) - floor(o + k * each), 3) AS BIGINT) AS copies FROM e
"""


def mixing_stage(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, columns as they were.

    Rows that share doc_id, source and size share their copies out in the order of a hash of the whole row, so that the
    mix keeps its total and reruns agree. Their ranks come from counts per hash cell and ranks within a cell, so that no
    window holds all rows of an id (or without one).
    """
    key = ["__mix_id", "__mix_source", "__mix_size"]
    names = docs.columns
    light = mix_sources(docs.select(F.col("doc_id").alias("doc_id"), "source", "text"))
    shared = light.groupBy(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size")).agg(F.sum("copies").alias("__mix_total"), F.count(F.lit(1)).alias("__mix_rows"))
    # Rows whose key gives none go before texts are moved; a row knows its key, so equality with nulls is by value.
    sized = docs.withColumn("__mix_n", n_words(F.col("text")))
    on = docs["doc_id"].eqNullSafe(F.col("__mix_id")) & docs["source"].eqNullSafe(F.col("__mix_source")) & (F.col("__mix_n") == F.col("__mix_size"))
    joined = sized.join(shared.filter("__mix_total > 0"), on)
    alone = joined.filter("__mix_rows = 1").withColumn("__mix_times", F.col("__mix_total"))
    hashed = joined.filter("__mix_rows > 1").withColumn("__mix_hash", F.xxhash64(*[F.col(c) for c in names]))
    hashed = hashed.withColumn("__mix_cell", F.shiftrightunsigned("__mix_hash", 54))
    # The counts need the rows that share a key only, without their texts.
    up = Window.partitionBy(*key).orderBy("__mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = hashed.groupBy(*key, "__mix_cell").agg(F.count(F.lit(1)).alias("n")).select(*[F.col(c).alias(f"c{c}") for c in (*key, "__mix_cell")], F.coalesce(F.sum("n").over(up), F.lit(0)).alias("__mix_before"))
    same = F.lit(True)
    for c in (*key, "__mix_cell"):
        same = same & F.col(c).eqNullSafe(F.col(f"c{c}"))
    nth = F.row_number().over(Window.partitionBy(*key, "__mix_cell").orderBy("__mix_hash")) + F.col("__mix_before")
    ranked = hashed.join(cells, same).withColumn("__mix_turn", nth)
    share = lambda turn: F.floor(F.col("__mix_total") * turn / F.col("__mix_rows"))
    many = ranked.withColumn("__mix_times", share(F.col("__mix_turn")) - share(F.col("__mix_turn") - 1))
    times = lambda frame: frame.filter("__mix_times > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).select(*names)
    return times(alone).unionByName(times(many))

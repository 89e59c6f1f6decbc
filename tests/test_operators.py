"""Literal cases and invariants of operators that SQL does not express."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratacloud import fixtures
from stratacloud.functions.crs import EPSG_2992, horizontal_block
from stratacloud.functions.morton import progressive_key
from stratacloud.operators import images
from stratacloud.operators.allocation import allocate
from stratacloud.plans import mixed_depth as md
from stratacloud.sources import ranges
from stratacloud.streaming import budget


def shares(spark, limits, budget, weights=None, priority=()):
    rows = [(7, i, n, weights[i] if weights else None, i in priority) for i, n in enumerate(limits)]
    got = allocate(spark.createDataFrame(rows, "request long, pos long, points long, weight double, priority boolean"), budget, 1 << 40, weighted=weights is not None)
    return [r["allocated"] for r in got.orderBy("pos").collect()]


def poured(limits, budget, order):
    """One point at a time to the entry that has least, the first of those; entries of one class in ``order``."""
    out = [0] * len(limits)
    for group in order:
        while budget and (open_ := [i for i in group if out[i] < limits[i]]):
            out[min(open_, key=lambda i: (out[i], i))] += 1
            budget -= 1
    return out


def test_fair_shares(spark):
    rng = random.Random(2)
    assert shares(spark, [9, 9, 9, 9], 20) == [5, 5, 5, 5]
    assert shares(spark, [6, 8], None) == [6, 8]
    for _ in range(12):
        limits = [rng.choice((0, 1, 3, 8, 30)) for _ in range(rng.randrange(1, 12))]
        first = {i for i in range(len(limits)) if rng.random() < 0.3}
        budget = rng.randrange(0, 90)
        rest = [i for i in range(len(limits)) if i not in first]
        assert shares(spark, limits, budget, priority=first) == poured(limits, budget, [sorted(first), rest])


def test_weighted_shares(spark):
    assert shares(spark, [500, 500, 500], 70, [4.0, 2.0, 1.0]) == [40, 20, 10]
    assert shares(spark, [7, 500, 500], 61, [4.0, 2.0, 1.0]) == [7, 36, 18]
    assert shares(spark, [3, 4], 99, [1.0, 5.0]) == [3, 4]
    rng = random.Random(3)
    for _ in range(8):
        limits, weights = [rng.randrange(0, 40) for _ in range(9)], [rng.choice((0.5, 1.0, 4.0)) for _ in range(9)]
        budget = rng.randrange(0, 200)
        got = shares(spark, limits, budget, weights)
        assert sum(got) == min(budget, sum(limits)) and all(0 <= g <= n for g, n in zip(got, limits))
        per = [g / w for g, n, w in zip(got, limits, weights) if g < n]
        assert all(g / w <= min(per, default=1e9) + 2 + 1 / w for g, w in zip(got, weights))  # a point more or less each
    with pytest.raises(Exception, match="positive weight"):
        shares(spark, [1], 1, [0.0])


def test_coalesced_ranges_literal(spark):
    rows = [("f", "a", 100, 20), ("f", "b", 120, 30), ("f", "c", 150, 10), ("f", "zero", 130, 0), ("f", "far", 165, 5)]
    e = spark.createDataFrame(rows, "source string, key string, begin long, length long")
    got = {r["key"]: (r["span_begin"], r["span_end"]) for r in ranges.coalesce_ranges(e).collect()}
    assert got == {"a": (100, 160), "b": (100, 160), "c": (100, 160), "zero": (130, 130), "far": (165, 170)}
    assert {(r["span_begin"], r["span_end"]) for r in ranges.coalesce_ranges(e, most_gap=5).filter("key <> 'zero'").collect()} == {(100, 170)}
    assert {(r["span_begin"], r["span_end"]) for r in ranges.coalesce_ranges(e, most_span=50).filter("key <> 'zero'").collect()} == {(100, 150), (150, 160), (165, 170)}
    with pytest.raises(Exception, match="twice"):
        ranges.coalesce_ranges(e.unionAll(e)).collect()


def test_capped_runs(spark):
    r = spark.createDataFrame([(1, 0, 9)], "request long, first_block long, last_block long")
    assert sorted((x["first_block"], x["last_block"]) for x in ranges.capped_runs(r, 4).collect()) == [(0, 3), (4, 7), (8, 9)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 31, 64, 100])
def test_progressive_prefixes(spark, n):
    """The closed form gives a permutation, and each of its prefixes spreads over the ranks."""
    keys = spark.range(n).select("id", progressive_key(F.col("id"), F.lit(n)).alias("k")).orderBy("k").collect()
    order = [r["id"] for r in keys]
    assert sorted(order) == list(range(n)) and len({r["k"] for r in keys}) == n
    if n >= 31:
        first = sorted(order[:8])
        assert max(b - a for a, b in zip(first, first[1:])) <= math.ceil(n / 4)


def test_lambert_round_trip(spark):
    x, y = EPSG_2992.forward(F.col("lon"), F.col("lat"))
    p = spark.createDataFrame([(-120.5, 41.75), (-123.1, 44.9), (-117.0, 46.2)], "lon double, lat double").select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = EPSG_2992.inverse(F.col("x"), F.col("y"))
    for r in p.select("lon", "lat", "x", "y", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9
    origin = p.first()
    assert abs(origin["x"] - 400000 / 0.3048) < 1e-3 and abs(origin["y"]) < 1e-3


def test_horizontal_wkt():
    assert horizontal_block('COMPD_CS["c [x]",PROJCS["p ]",GEOGCS["g"]],VERT_CS["v"]]') == 'PROJCS["p ]",GEOGCS["g"]]'
    assert horizontal_block(" LOCAL_CS[1] ") == "LOCAL_CS[1]"
    with pytest.raises(ValueError):
        horizontal_block('GEOGCS["g"')


def _catalog():
    keys = ["0-0-0-0"] + [f"1-{x}-{y}-{z}" for x in (0, 1) for y in (0, 1) for z in (0, 1)] + [f"2-{x}-{y}-0" for x in range(4) for y in range(4)]
    return {k: md.Node(k, 10, 360, error=40.0 / (1 + i % 5), benefit=float(100 - i)) for i, k in enumerate(keys)}


def test_node_refinement_invariants():
    nodes = _catalog()
    got = md.refine_nodes(nodes, md.Budget(nodes=9, points=90))
    assert "0-0-0-0" in got and len(got) <= 9
    assert all(md.parent_of(k) in got for k in got if k != "0-0-0-0")


def test_sibling_refinement_is_atomic():
    nodes = _catalog()
    base = md.baseline(nodes, md.Budget(nodes=40), target=2)
    assert base == {k for k in nodes if k[0] in "01"}
    got = md.refine_siblings(nodes, md.Budget(nodes=18), base)
    for parent in {md.parent_of(k) for k in nodes if k[0] == "2"}:
        family = {k for k in nodes if md.parent_of(k) == parent}
        assert family <= got or not family & got
    assert len(got) <= 18
    assert md.refine_siblings(nodes, md.Budget(), set()) == set()


def test_output_sets():
    nodes = _catalog()
    nodes["1-0-0-0"].ready = False
    planned = {"0-0-0-0", "1-0-0-0", "1-1-0-0", "2-0-0-0"}
    sets = md.output_sets(nodes, planned)
    assert sets["frontier"] == {"1-1-0-0", "2-0-0-0"} and sets["ancestor"] == {"0-0-0-0", "1-0-0-0"}
    assert sets["render"] == {"0-0-0-0", "1-1-0-0"} and sets["request"] == {"1-0-0-0"} and sets["blocked"] == {"2-0-0-0"}


def test_budget_step():
    calm = dict(render=100, total=100, decode=10, worker=10, trip=10)
    s = budget.step(budget.start(), calm | {"render": 3000})
    assert s["rendered"] == 270_000 and s["source_points"] == 900_000
    s = budget.step(s, calm | {"decode": 9000})
    assert s["source_points"] == 405_000 and s["streak"] == 0
    for _ in range(2):
        s = budget.step(s, calm)
    assert s["streak"] == 2 and s["rendered"] == 270_000
    assert budget.step(s, calm)["rendered"] == 337_500


def test_byte_ranges(spark, tmp_path):
    from stratacloud.sources.files import ByteRangeSource, Sources

    path = tmp_path / "f.bin"
    path.write_bytes(bytes(range(256)))
    spark.dataSource.register(ByteRangeSource)
    rows = spark.read.format("byteranges").option("path", str(path)).option("ranges", "0-4,250-256").load().orderBy("begin").collect()
    assert [bytes(r["data"]) for r in rows] == [bytes(range(4)), bytes(range(250, 256))]
    with pytest.raises(Exception):
        spark.read.format("byteranges").option("path", str(path)).option("ranges", "250-300").load().collect()
    s, blob = Sources(), object()
    assert s.key("http://x") == "url:http://x" and s.key(blob) == s.key(blob) == "blob:1"


def test_sink_and_facade(spark, small, tmp_path):
    from stratacloud.api import ParquetSink, PointCloud
    from stratacloud.queries.planners import CAMERA

    cloud = PointCloud.load(spark, small, sink=ParquetSink(str(tmp_path / "out")))
    assert cloud.sink.takes_batches is False
    n = cloud.render(CAMERA, 1_000, 50).count()
    assert spark.read.parquet(str(tmp_path / "out/revision=1")).count() == n > 0
    assert cloud.select(CAMERA, ancestors=False).count() <= cloud.select(CAMERA).count()
    root = cloud.points.filter("node_key = '0-0-0-0'").count()
    assert cloud.project(cloud.node_sample("0-0-0-0"), elevation=True).count() == root > 0


def test_missing_ancestors_close_strictly(spark, small):
    from stratacloud.operators.tree import lenient_closure, strict_closure

    n = fixtures.nodes(spark, small)
    frontier = n.filter("depth = 3")
    assert lenient_closure(frontier, n).count() > 0
    assert strict_closure(frontier, n).count() == 0  # the smallest cloud has orphans


def test_mask_gaps_and_axes(spark):
    rows = [(x, 0, x in (0, 3)) for x in range(5)]
    m = spark.createDataFrame(rows, "px long, py long, v boolean")
    assert sorted(r["px"] for r in images.bounded_gaps(m, 2).collect()) == [1, 2]
    assert images.bounded_gaps(m, 1).count() == 0
    a, b = spark.range(1).select(*images.ellipse_axes(F.lit(4.0), F.lit(0.0), F.lit(1.0))).first()
    assert (a, b) == (2.0, 1.0)


def test_pages_and_progress(spark, small):
    from stratacloud.api import PointCloud
    from stratacloud.queries.planners import CAMERA

    cloud = PointCloud.load(spark, small)
    none = spark.createDataFrame([], "page string")
    assert cloud.with_pages(none).nodes.agg(F.max("depth")).first()[0] == 1
    one = cloud.load_next_page(none)
    assert [r["page"] for r in one.collect()] == ["2-0-0-0"]
    two = cloud.load_page(one, "2-1-0-0")
    assert cloud.with_pages(two).nodes.filter("depth >= 2").count() > 0 and cloud.pending_pages(two).filter("page = '2-1-0-0'").isEmpty()
    with pytest.raises(KeyError):
        cloud.load_page(two, "2-1-0-0")
    seen = []
    assert cloud.progressive(CAMERA, 500, 20, 8, lambda frame, turn: seen.append(frame.count()) or len(seen) == 2) == 2
    assert 0 < seen[0] <= seen[1]


def test_shared_tasks(spark):
    from stratacloud.api import PointCloud
    from stratacloud.streaming.tasks import Prefetch, SharedTask, runs_engine

    task = SharedTask(spark, lambda: spark.range(10))
    assert task.run() == 10 and task.consume().count() == 10
    task.leave()
    assert task.reusable
    task.leave()
    assert not task.reusable
    with pytest.raises(RuntimeError):
        task.consume()
    p = Prefetch()
    first = p.start(SharedTask(spark, lambda: spark.range(3)))
    second = p.start(SharedTask.fulfilled(spark.range(4)))
    assert first.aborted and not second.aborted and second.consume().count() == 4
    assert runs_engine(PointCloud(spark.range(0), spark.range(0))) and not runs_engine(object())


def test_camera_stream(spark, small, tmp_path):
    from stratacloud.streaming import camera

    got = []
    stream = camera.CameraStream(camera.read_events(spark, small), lambda batch, epoch: got.append((epoch, batch.count())))
    stream.start(str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    stream.stop()
    users = spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().count()
    assert got == [(0, users)]


def test_keys_of_all_events(spark, small):
    """Places over the whole table, hour by hour, and overlaps counted without pairs."""
    from stratacloud.operators import tree
    from stratacloud.queries.trees import stream_keys

    events = spark.read.parquet(f"{small}/events.parquet").orderBy("ts", "event_id").select("event_id", "value").collect()
    got = stream_keys(spark, small).orderBy("pos").collect()
    assert len(events) > 300 and [r["pos"] for r in got] == list(range(1, len(events) + 1))
    assert [r["value"] for r in got] == [r["value"] for r in events]
    up = [[int(i) for i in r["key"].split("-")] for r in got]
    under = lambda a, b: a[0] <= b[0] and all(y >> (b[0] - a[0]) == x for x, y in zip(a[1:], b[1:]))
    want = sum(under(a, b) or under(b, a) for i, a in enumerate(up) for b in up[:i])
    assert tree.ancestor_overlaps(stream_keys(spark, small)).first()["overlaps"] == want


def test_rows_of_all_points(spark, small):
    from stratacloud.catalog import QUERIES

    assert QUERIES["snk_2_row_output"](spark, small).count() == spark.read.parquet(f"{small}/orders.parquet").count()


def test_streams_write_tables(spark, small):
    """The result of a stream is a table of files, with a checkpoint beside it, and no memory of the driver."""
    from stratacloud.streaming import camera

    frame = camera.run_to_end(camera.newest(camera.read_events(spark, small)), "complete")
    users = spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().count()
    assert frame.count() == users and all("/stream-" in f for f in frame.inputFiles())


def test_spans_within_a_cap(spark):
    """The pass over sorted ranges against a plain loop, over several sources and batches."""
    rng = random.Random(6)
    rows = []
    for source in ("a", "b", "c"):
        at = 0
        for k in range(200):
            at += rng.choice((-3, 0, 0, 0, 2, 9))
            n = rng.choice((0, 5, 20, 40))
            rows.append((source, f"k{k}", max(at, 0), n))
            at = max(at, 0) + n
    want = {}
    for source in ("a", "b", "c"):
        span = []
        for _, k, b, n in sorted((r for r in rows if r[0] == source and r[3]), key=lambda r: (r[2], r[2] + r[3], r[1])):
            if span and 0 <= b - span[-1][2] <= 4 and b + n - span[0][1] <= 100:
                span.append((k, b, b + n))
            else:
                want |= {(source, s): (span[0][1], span[-1][2]) for s, _, _ in span}
                span = [(k, b, b + n)]
        want |= {(source, s): (span[0][1], span[-1][2]) for s, _, _ in span}
        want |= {(source, k): (b, b) for s, k, b, n in rows if s == source and not n}
    e = spark.createDataFrame(rows, "source string, key string, begin long, length long").repartition(3)
    got = {(r["source"], r["key"]): (r["span_begin"], r["span_end"]) for r in ranges.coalesce_ranges(e, most_gap=4, most_span=100).collect()}
    assert got == want
    free = {(r["source"], r["key"]): (r["span_begin"], r["span_end"]) for r in ranges.coalesce_ranges(e, most_gap=4, most_span=None).collect()}
    assert free == {(r["source"], r["key"]): (r["span_begin"], r["span_end"]) for r in ranges.coalesce_ranges(e, most_gap=4, most_span=1 << 40).collect()}


def test_range_store(spark, tmp_path):
    """What the store lacks is read once, in whole blocks; what it has is not read again."""
    from stratacloud.sources.cache import CachedRanges, FolderRangeCache

    path = tmp_path / "f.bin"
    path.write_bytes(bytes(i % 251 for i in range(10_000)))
    asked = spark.createDataFrame([(1, 0, 10), (2, 4_090, 4_100), (3, 9_990, 10_000)], "request long, begin long, end long")
    store = FolderRangeCache(spark, str(tmp_path / "store"))
    getter = CachedRanges(spark, str(path), store, block=4096)
    for turn, fetched in enumerate((3, 0)):
        got = {r["request"]: bytes(r["data"]) for r in getter.read(asked).collect()}
        assert got == {1: bytes(range(10)), 2: bytes(i % 251 for i in range(4_090, 4_100)), 3: bytes(i % 251 for i in range(9_990, 10_000))}
        assert getter.fetched_blocks == fetched, turn
    store.delete(getter.source)
    assert store.blocks(getter.source).count() == 0


def random_tree(seed):
    rng = random.Random(seed)
    keys, level = ["0-0-0-0"], ["0-0-0-0"]
    for _ in range(3):
        level = [f"{d + 1}-{2 * x + a}-{2 * y + b}-{2 * z + c}" for d, x, y, z in (map(int, k.split("-")) for k in level) for a in (0, 1) for b in (0, 1) for c in (0, 1) if rng.random() < 0.4]
        keys += level
    return {k: md.Node(k, rng.choice((0, 5, 9, 20)) if i else 3, 36, rng.uniform(0, 60), rng.choice((1.0, 2.0, 5.0, 9.5)), rng.random() < 0.9) for i, k in enumerate(keys)}


def best_first(nodes, budget, options):
    """Plain refinement: all options are rated again for each pick; ``options(picked)`` gives (gain, new keys, ranking node)."""
    picked = yield
    while True:
        used = md.usage_of(nodes[k] for k in picked)
        fits = [(md._rank(gain, md.usage_of(nodes[k] for k in new), nodes[at], budget), new) for gain, new, at in options(picked) if budget.holds(md._add(used, md.usage_of(nodes[k] for k in new)))]
        if not fits:
            return picked
        picked = picked | set(min(fits)[1])


def plainly(nodes, budget, start, options):
    run = best_first(nodes, budget, options)
    next(run)
    try:
        run.send(set(start))
    except StopIteration as end:
        return end.value


@pytest.mark.parametrize("seed", range(25))
def test_refinement_by_heap_equals_rating_all(seed):
    nodes = random_tree(seed)
    budget = md.Budget(5 + seed, 60 + 10 * seed, None)
    usable = lambda new: all(k in nodes and not nodes[k].empty for k in new)
    worthy = {k: n for k, n in nodes.items() if n.visible and not n.empty and (n.address[0] == 0 or n.error >= md.REFINE_ERROR)}

    def by_node(picked):
        for k in worthy:
            new = [p for p in md.path_of(k) if p not in picked]
            if k not in picked and usable(new):
                yield sum(worthy[p].benefit for p in new if p in worthy), new, k

    assert md.refine_nodes(nodes, budget) == plainly(nodes, budget, (), by_node)
    families = {}
    for k, n in nodes.items():
        if n.visible and not n.empty and md.parent_of(k):
            families.setdefault(md.parent_of(k), []).append(k)

    def by_family(picked):
        for parent, family in families.items():
            due = nodes[parent].error >= md.REFINE_ERROR or any(nodes[k].error >= md.REFINE_ERROR for k in family)
            if parent in picked and not any(k in picked for k in family) and due:
                yield sum(nodes[k].benefit for k in family), family, parent

    assert md.refine_siblings(nodes, budget, {"0-0-0-0"}) == plainly(nodes, budget, ("0-0-0-0",), by_family)

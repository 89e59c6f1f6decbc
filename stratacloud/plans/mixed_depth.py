"""Mixed-depth traversal: a baseline cut of the tree, then refinement by benefit per cost.

After each pick all scores change, so there is no relational form; the loop runs per camera over the catalog's
candidates (``applyInPandas``), and its sets are joined to points by key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.geometry import horizontal_span, screen_pixels
from stratacloud.plans.selection import Camera, candidates, over_budget

REFINE_ERROR, RETAIN_SHARE = 16.0, 0.75


class RequiredCoverageError(ValueError):
    """A required baseline can't be planned: unknown-node, non-renderable-node, missing-ancestor or budget-exceeded."""

    def __init__(self, code: str, key: str | None = None):
        super().__init__(f"{code}: {key}" if key else code)
        self.code, self.key = code, key


@dataclass
class Node:
    key: str
    points: int
    bytes: int
    error: float = 0.0
    benefit: float = 0.0
    visible: bool = True
    ready: bool = True
    address: tuple[int, int, int, int] = field(init=False)

    def __post_init__(self) -> None:
        self.address = tuple(int(p) for p in self.key.split("-"))

    @property
    def order(self) -> tuple:
        d, x, y, z = self.address
        return d, z, y, x, self.key

    @property
    def empty(self) -> bool:
        return self.points <= 0 or self.bytes <= 0


def parent_of(key: str) -> str | None:
    d, x, y, z = map(int, key.split("-"))
    return f"{d - 1}-{x >> 1}-{y >> 1}-{z >> 1}" if d else None


def path_of(key: str) -> list[str]:
    """Root first."""
    d, x, y, z = map(int, key.split("-"))
    return [f"{k}-{x >> d - k}-{y >> d - k}-{z >> d - k}" for k in range(d + 1)]


@dataclass(frozen=True)
class Budget:
    nodes: int | None = None
    points: int | None = None
    bytes: int | None = None

    def holds(self, usage: tuple[int, int, int]) -> bool:
        return all(limit is None or used <= limit for used, limit in zip(usage, (self.nodes, self.points, self.bytes)))

    def cost(self, usage: tuple[int, int, int]) -> float:
        return sum(used / limit for used, limit in zip(usage, (self.nodes, self.points, self.bytes)) if limit)


def usage_of(nodes: Iterable[Node]) -> tuple[int, int, int]:
    picked = list(nodes)
    return len(picked), sum(n.points for n in picked), sum(n.bytes for n in picked)


def _add(a, b):
    return tuple(x + y for x, y in zip(a, b))


def closure(keys: Iterable[str], nodes: dict[str, Node]) -> set[str] | None:
    """The keys and their ancestors; None if one has no usable node."""
    out = {k for key in keys for k in path_of(key)}
    return out if all(k in nodes and not nodes[k].empty for k in out) else None


def required_cover(required: list[str], nodes: dict[str, Node], budget: Budget) -> set[str]:
    """The closure of a required baseline, or an error that says what is wrong with it."""
    for key in required:
        if key not in nodes:
            raise RequiredCoverageError("unknown-node", key)
        if nodes[key].empty:
            raise RequiredCoverageError("non-renderable-node", key)
        if any(k not in nodes for k in path_of(key)):
            raise RequiredCoverageError("missing-ancestor", key)
    out = {k for key in required for k in path_of(key)}
    if not budget.holds(usage_of(nodes[k] for k in out)):
        raise RequiredCoverageError("budget-exceeded")
    return out


def _threshold(retained: bool) -> float:
    return REFINE_ERROR * (RETAIN_SHARE if retained else 1.0)


def _rank(gain: float, usage: tuple[int, int, int], node: Node, budget: Budget) -> tuple:
    """Order of options, best first: gain per cost; ties by gain, lower cost, deeper, then place.

    Gains are whole thousandths, so that ties do not hang on the order in which benefits are summed.
    """
    gain, cost = round(gain, 3), budget.cost(usage)
    d, z, y, x, key = node.order
    return (-(gain / cost) if cost else float("-inf"), -gain, cost, -d, z, y, x, key)


def refine_nodes(nodes: dict[str, Node], budget: Budget, previous: set[str] = frozenset(), chosen: set[str] = frozenset()) -> set[str]:
    """Node mode: each pick is a node with those of its ancestors that aren't chosen yet.

    A pick changes the options of the nodes below what it adds, and only these: they go on the heap anew, and older
    entries of theirs are passed over. What doesn't fit now may fit when an ancestor has been picked, and comes again then.
    """
    picked = set(chosen)
    used = usage_of(nodes[k] for k in picked)
    worthy = {k: n for k, n in nodes.items() if n.visible and not n.empty and (n.address[0] == 0 or n.error >= _threshold(k in previous))}
    under: dict[str, list[str]] = {}
    for key in worthy:
        for up in path_of(key)[:-1]:
            under.setdefault(up, []).append(key)
    heap: list[tuple] = []
    now: dict[str, tuple] = {}

    def offer(key: str) -> None:
        new = [k for k in path_of(key) if k not in picked]
        if key in picked or any(k not in nodes or nodes[k].empty for k in new):
            return
        usage = usage_of(nodes[k] for k in new)
        now[key] = _rank(sum(worthy[k].benefit for k in new if k in worthy), usage, nodes[key], budget)
        heapq.heappush(heap, (now[key], usage, key, new))

    for key in worthy:
        offer(key)
    while heap:
        rank, usage, key, new = heapq.heappop(heap)
        if key in picked or now[key] != rank or not budget.holds(_add(used, usage)):
            continue
        picked.update(new)
        used = _add(used, usage)
        for below in {k for n in new for k in under.get(n, ())}:
            offer(below)
    return picked


def refine_siblings(nodes: dict[str, Node], budget: Budget, baseline: set[str], previous: set[str] = frozenset()) -> set[str]:
    """Sibling mode: a frontier node's visible children come all together or not at all.

    The rank of a family never changes and the room only shrinks, so each family is weighed once, when its parent is in.
    """
    if not baseline:
        return set()
    picked = set(baseline)
    used = usage_of(nodes[k] for k in picked)
    kept = {k for key in previous for k in path_of(key)}
    children: dict[str, list[str]] = {}
    for key, node in nodes.items():
        if node.visible and not node.empty and (parent := parent_of(key)):
            children.setdefault(parent, []).append(key)
    heap: list[tuple] = []

    def offer(parent: str) -> None:
        family = children.get(parent, [])
        if not family or any(k in picked for k in family):
            return
        if nodes[parent].error >= _threshold(parent in kept) or any(nodes[k].error >= _threshold(k in kept) for k in family):
            usage = usage_of(nodes[k] for k in family)
            heapq.heappush(heap, (_rank(sum(nodes[k].benefit for k in family), usage, nodes[parent], budget), usage, parent))

    for key in sorted(picked):
        offer(key)
    while heap:
        _, usage, parent = heapq.heappop(heap)
        if budget.holds(_add(used, usage)):
            picked.update(children[parent])
            used = _add(used, usage)
            for key in children[parent]:
                offer(key)
    return picked


def tree_cut(nodes: dict[str, Node], depth: int) -> set[str]:
    """Visible nodes down to a depth that have no chosen descendant."""
    level = {k for k, n in nodes.items() if n.visible and not n.empty and n.address[0] <= depth}
    return level - {a for k in level for a in path_of(k)[:-1]}


def baseline(nodes: dict[str, Node], budget: Budget, target: int) -> set[str] | None:
    """The deepest cut at or above the wanted depth whose closure exists and fits."""
    depths = sorted({n.address[0] for n in nodes.values() if not n.empty})
    wanted = max(1, target - 1) if target > 0 else 0
    for depth in sorted((d for d in depths if d <= wanted), reverse=True):
        whole = closure(tree_cut(nodes, depth), nodes)
        if whole and budget.holds(usage_of(nodes[k] for k in whole)):
            return whole
    return None


def output_sets(nodes: dict[str, Node], planned: set[str]) -> dict[str, set[str]]:
    """planned, frontier, ancestor, render, request, blocked and retained parents."""
    frontier = planned - {parent_of(k) for k in planned}
    render = {k for k in planned if all(a in planned and nodes[a].ready for a in path_of(k))}
    return {
        "planned": planned,
        "frontier": frontier,
        "ancestor": planned - frontier,
        "render": render,
        "request": {k for k in planned if not nodes[k].ready},
        "blocked": {k for k in planned if nodes[k].ready} - render,
        "retained_parent": (render - {parent_of(k) for k in render}) - frontier,
    }


SETS = ("planned", "frontier", "ancestor", "render", "request", "blocked", "retained_parent")
_SCHEMA = "camera_id long, key string, " + ", ".join(f"{s} boolean" for s in SETS)


def plan_views(views: DataFrame, budget: Budget, target: int, siblings: bool = True) -> DataFrame:
    """Plan each camera of ``views`` (camera_id, key, point_count, data_length, error, benefit, visible, ready).

    Returns (camera_id, key, and a boolean per set). A camera sees the catalog's candidates, which bounds its group.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = {r.key: Node(r.key, int(r.point_count), int(r.data_length), float(r.error), float(r.benefit), bool(r.visible), bool(r.ready)) for r in frame.itertuples()}
        if siblings:
            base = baseline(nodes, budget, target)
            planned = refine_siblings(nodes, budget, base) if base else set()
        else:
            planned = refine_nodes(nodes, budget)
        sets = output_sets(nodes, planned)
        rows = [(frame["camera_id"].iat[0], k, *[k in sets[s] for s in SETS]) for k in sorted(planned, key=lambda k: nodes[k].order)]
        return pd.DataFrame(rows, columns=["camera_id", "key", *SETS])

    return views.groupBy("camera_id").applyInPandas(run, _SCHEMA)


def view_states(found: DataFrame, camera: Camera) -> DataFrame:
    """Per candidate its error, benefit and visibility. A parent is blocked while a visible child is over its own budget."""
    spacing = screen_pixels(camera.spacing / F.pow(F.lit(2.0), F.col("depth")), F.col("eye_distance"), camera.viewport)
    pixels = screen_pixels(horizontal_span(), F.col("eye_distance"), camera.viewport)
    error = spacing if camera.spacing_pixels is not None else pixels
    heavy = over_budget(F.col("point_count"), camera.max_node_points) | over_budget(F.col("data_length"), camera.max_node_bytes)
    benefit = F.least(F.lit(float((1 << 53) - 1)), error * F.greatest(F.lit(1.0), pixels * pixels))
    return found.select(F.lit(0).cast("bigint").alias("camera_id"), "key", "point_count", "data_length", error.alias("error"), benefit.alias("benefit"), (~heavy).alias("visible"), F.lit(True).alias("ready"), "depth")


def select_mixed(nodes: DataFrame, camera: Camera, target: int | None = None) -> DataFrame:
    from stratacloud.plans.selection import depth_estimates, target_depth

    found = candidates(nodes, camera)
    if target is None:
        target = target_depth(depth_estimates(found, camera), camera).first()["target"] or 0
    views = view_states(found, camera).filter("visible")
    return plan_views(views, Budget(camera.max_nodes, camera.max_points, camera.max_bytes), int(target))

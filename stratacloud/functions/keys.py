"""Node keys ``depth-x-y-z``: parsing, boxes, parents, ancestors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Depth of a malformed key: it sorts after all others.
NO_DEPTH = (1 << 53) - 1


def node_key(depth, x, y, z) -> Column:
    return F.concat_ws("-", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in (depth, x, y, z)])


def parse_key(key: Column) -> dict[str, Column]:
    """depth, x, y, z as longs; null where the key is malformed."""
    parts = F.split(key, "-")
    whole = key.rlike(r"^\d+-\d+-\d+-\d+$")
    return {name: F.when(whole, F.get(parts, F.lit(i)).try_cast("bigint")) for i, name in enumerate(("depth", "x", "y", "z"))}


def key_depth(key: Column) -> Column:
    return F.coalesce(F.get(F.split(key, "-"), F.lit(0)).try_cast("bigint"), F.lit(NO_DEPTH))


def node_bounds(depth: Column, x: Column, y: Column, z: Column, cube: tuple) -> dict[str, Column]:
    """The box of a node: its cell of the cube cut into 2**depth per axis."""
    out = {}
    for n, i, c in (("x", 0, x), ("y", 1, y), ("z", 2, z)):
        side = (cube[i + 3] - cube[i]) / F.pow(F.lit(2.0), depth)
        out[f"min_{n}"], out[f"max_{n}"] = cube[i] + c * side, cube[i] + (c + 1) * side
    return {k: out[k] for k in ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")}


def parent_key(key: Column) -> Column:
    """The key with halved indices one level up; null for the root and for malformed keys."""
    p = parse_key(key)
    return F.when(p["depth"] > 0, F.concat_ws("-", *[c.cast("string") for c in (p["depth"] - 1, F.shiftright(p["x"], 1), F.shiftright(p["y"], 1), F.shiftright(p["z"], 1))]))


def ancestor_keys(key: Column) -> Column:
    """Root first, the key itself last."""
    p = parse_key(key)
    up = lambda c, k: F.floor(c / F.pow(F.lit(2.0), p["depth"] - k)).cast("bigint").cast("string")
    return F.transform(F.sequence(F.lit(0).cast("bigint"), p["depth"]), lambda k: F.concat_ws("-", k.cast("string"), up(p["x"], k), up(p["y"], k), up(p["z"], k)))


def is_ancestor(upper: Column, lower: Column) -> Column:
    """Whether ``upper`` is an ancestor of ``lower``; every key is one of itself."""
    return F.array_contains(ancestor_keys(lower), upper)

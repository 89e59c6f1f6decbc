"""Status lines of the viewer as columns: numbers with thousands separators, shares, budgets, ranges of depths.

The wording is that of the interface; how a line is put together is here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wording that readers of the lines rely on.
NOT_YET = "Not streamed yet"
MODES = {"nearest": "nearest", "complete": "coverage", "progressive": "progressive coverage", "mixed": "mixed-depth coverage"}


def number(c: Column, digits: int = 0) -> Column:
    """With thousands separators and at most ``digits`` decimals."""
    text = F.format_number(c.cast("double"), digits)
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text


def millis(c: Column) -> Column:
    return F.concat(number(c), F.lit(" ms"))


def mebibytes(c: Column) -> Column:
    return F.concat(number(c / (1 << 20), 1), F.lit(" MiB"))


def share(c: Column) -> Column:
    return F.concat(number(c * 100, 1), F.lit("%"))


def line(*parts: Column | str) -> Column:
    """Parts one after the other; null parts are left out."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def if_any(count: Column, text: str) -> Column:
    """``, n text`` where there are any."""
    return F.when(count > 0, line(", ", number(count), " " + text))


def budget(now: Column, most: Column, label: str, show=number) -> Column:
    """The whole budget, or how much of it applies at present."""
    return F.when(now == most, line(show(most), " " + label)).otherwise(line(show(now), " / ", show(most), f" {label} adaptive"))


def between(low: Column, high: Column, one: str, many: str) -> Column:
    return F.when(low == high, line(one + " ", number(high))).otherwise(line(many + " ", number(low), "-", number(high)))


def diagnostics(expand: Column, apply: Column, select: Column, render: Column, total: Column, pages: Column, nodes: Column, depth: Column, points: Column, length: Column) -> Column:
    steps = zip(("expand", "apply", "select", "render", "total"), (expand, apply, select, render, total))
    return line(*[p for name, c in steps for p in (name + " ", millis(c), ", ")], number(pages), " pages, ", number(nodes), " nodes, depth ", number(depth), ", source ", number(points), " pts / ", mebibytes(length))


def detail_progress(rendered: Column, final: Column, coverage: Column, weighted: Column, at_budget: Column) -> Column:
    differs = F.when(F.abs(weighted - coverage) > 0.001, line(", ", share(weighted), " weighted"))
    text = line(number(rendered), " / ", number(final), " current-view nodes (", share(coverage), " coverage", differs, F.when(at_budget, ", render budget reached"), ")")
    return F.when(final.isNull(), NOT_YET).otherwise(text)


def lod_summary(label: Column, height: Column, depth: Column, node_pixels: Column, spacing_pixels: Column, nodes: Column, budgets: list[Column]) -> Column:
    sums = [p for k, b in enumerate(budgets) for p in ((" / ", b) if k else (b,))]
    text = line(label, ", camera ", number(height, 1), " m, depth <= ", number(depth), ", tile target ", number(node_pixels), " px, point spacing ", number(spacing_pixels, 2), " px, source budget ", *sums, ", up to ", number(nodes), " nodes")
    return F.when(label.isNull(), NOT_YET).otherwise(text)


def selection(mode: Column, nodes: Column, low: Column, high: Column, target: Column, pixels: Column, wanted: Column, root: Column, spacing: Column, wanted_spacing: Column, outside_frustum: Column, outside_view: Column, over_budget: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])
    spaced = F.when(spacing.isNotNull() & wanted_spacing.isNotNull(), line(", spacing ", number(spacing, 1), " px / ", number(wanted_spacing, 1), " px target"))
    sizes = line("target depth ", number(target), ", selected depth ", number(pixels), " px / ", number(wanted), " px target, root ", number(root), " px")
    skipped = line(if_any(outside_frustum, "outside frustum"), if_any(outside_view, "outside view"), if_any(over_budget, "skipped by budget"))
    return line(number(nodes), " ", F.element_at(names, mode), " nodes at ", between(low, high, "depth", "depths"), " (", sizes, spaced, skipped, ")")


def loaded_pages(pages: Column) -> Column:
    return F.when(pages > 0, line(" after loading ", number(pages), " hierarchy pages")).otherwise("")


def final_node_mix(detail: Column, final: Column) -> Column:
    return F.when(detail > 0, line(number(detail), " selected detail nodes for the current view")).otherwise(line(number(final), " coverage nodes for this zoom level"))


def budget_summary(now: Column, most: Column, configured: Column, others: list[Column]) -> Column:
    limit = F.when(most != configured, line(" (", number(configured), " configured max)"))
    return line(budget(now, most, "render pts cap"), limit, *[p for b in others for p in (" / ", b)])


def visual_quality(ready: Column, rendered: Column, required: Column, front: Column, fronts: Column, low: Column, high: Column, missing: Column, unexpected: Column, overlaps: Column, pending: Column, known: Column) -> Column:
    frontier = F.when(low.isNull() | high.isNull(), "no frontier").otherwise(between(low, high, "frontier depth", "frontier depth"))
    pages = F.when(pending == 1, " pending hierarchy page").otherwise(" pending hierarchy pages")
    hierarchy = F.when(known & (pending == 0), "hierarchy complete for view").when(pending == 0, "hierarchy completeness unknown").otherwise(line(number(pending), pages))
    state = F.when(ready, "terminal-ready").otherwise("refining")
    counts = line(number(rendered), " / ", number(required), " additive nodes, ", number(front), " / ", number(fronts), " frontier nodes, ", frontier)
    proof = line(number(missing), " missing, ", number(unexpected), " stale/unexpected, ", number(overlaps), " frontier overlaps")
    return F.when(required.isNull(), NOT_YET).otherwise(line(state, ", ", counts, ", ", proof, ", ", hierarchy))

"""Samples that match target category proportions (problem 4), by controlled rounding.

The targets of a plan form a table of kind by prop (one row or column where
only the other is named).  Fractional quotas are share x sample rows, raised to
``min_rows`` and lowered to what there is; if that is less than the sample rows,
the others grow in proportion, and if minima make it more, so is the sample.
They are made whole by a maximum
flow that keeps every cell and every row and column sum between the floor and
the ceiling of its fractional value, and the total at its nearest whole number.

Targets of one plan may overlap (a kind, a prop, both).  So the records of a
plan are told apart by the kinds and props its targets name, each record in one
*cell*; a target's quota is spread over its cells in proportion to what they
hold, no cell giving more than it has, and made whole by a second rounding over
targets by cells.  Each cell then gives exactly its sum of records, those of the
lowest random keys, dealt out to its targets in their order: no record is drawn
twice in a plan.

A target is unmet if the records drawn for its category exhaust it and are
still fewer than needed.

Scale: one scan counts categories (partial aggregation first); the flow runs on
the driver over targets and cells, whose number is the table of plans, not the
data.  The draw ranks only the one bucket of random keys in which a cell's
quota ends, and the drawn records where targets share a cell.

Defined results: a record belongs to the terms of its ``kind`` and ``prop``;
nulls belong nowhere; deliveries count once; targets without kind and prop, or
with a null share, have quota ``min_rows`` of nothing and count as unmet when
that is above zero; an empty table leaves every positive target unmet.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import lowest, ranked
from ..functions.text import term
from ..runtime import cut, draw
from .records import once


def max_flow(n: int, arcs: list[tuple[int, int, int]], s: int, t: int) -> tuple[int, list[int]]:
    """Maximum flow by shortest augmenting levels; returns its value and the flow on each arc."""
    to, cap, out = [], [], [[] for _ in range(n)]
    for a, b, c in arcs:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(0)
    value = 0
    while True:
        level = [-1] * n
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return value, [arcs[i][2] - cap[2 * i] for i in range(len(arcs))]
        at = [0] * n

        def push(x: int, most: int) -> int:
            if x == t:
                return most
            while at[x] < len(out[x]):
                e = out[x][at[x]]
                if cap[e] and level[to[e]] == level[x] + 1:
                    got = push(to[e], min(most, cap[e]))
                    if got:
                        cap[e] -= got
                        cap[e ^ 1] += got
                        return got
                at[x] += 1
            return 0

        while got := push(s, 1 << 60):
            value += got


def controlled_rounding(cells: dict[tuple, float]) -> dict[tuple, int]:
    """Whole numbers next to the fractional cells ``(row, column)`` such that every margin is next to its own sum.

    Each cell becomes its floor or ceiling, each row sum and column sum the
    floor or ceiling of its fractional sum, the total the nearest whole number.
    """
    near = 1e-9
    floor = lambda x: math.floor(x + near)
    up = lambda x: math.ceil(x - near)
    rows, cols = sorted({r for r, _ in cells}, key=repr), sorted({c for _, c in cells}, key=repr)
    row_sum, col_sum = defaultdict(float), defaultdict(float)
    for (r, c), v in cells.items():
        row_sum[r] += v
        col_sum[c] += v
    total = sum(cells.values())
    whole = math.floor(total + 0.5)
    # Nodes: source, sink, super source, super sink, rows, columns. An arc with a lower bound sends it by the super nodes.
    n = 4 + len(rows) + len(cols)
    row_at = {r: 4 + i for i, r in enumerate(rows)}
    col_at = {c: 4 + len(rows) + i for i, c in enumerate(cols)}
    bounded = [(0, row_at[r], floor(row_sum[r]), up(row_sum[r])) for r in rows]
    bounded += [(col_at[c], 1, floor(col_sum[c]), up(col_sum[c])) for c in cols]
    keys = list(cells)
    first = len(bounded)
    bounded += [(row_at[r], col_at[c], floor(cells[r, c]), up(cells[r, c])) for r, c in keys]
    bounded.append((1, 0, whole, whole))
    excess = [0] * n
    arcs = []
    for a, b, low, high in bounded:
        arcs.append((a, b, high - low))
        excess[b] += low
        excess[a] -= low
    for x in range(n):
        if excess[x] > 0:
            arcs.append((2, x, excess[x]))
        elif excess[x] < 0:
            arcs.append((x, 3, -excess[x]))
    need = sum(e for e in excess if e > 0)
    value, flow = max_flow(n, arcs, 2, 3)
    assert value == need, "a table of fractions always has a controlled rounding"
    return {k: bounded[first + i][2] + flow[first + i] for i, k in enumerate(keys)}


def quotas(targets: list[dict], sample_rows: int) -> None:
    """Set ``needed``, ``quota`` and ``unmet`` of a plan's targets, each with ``kind, prop, share, min_rows, available``."""
    goals: dict[tuple, float] = defaultdict(float)
    have = {}
    for t in targets:
        share, least = t["share"] or 0.0, t["min_rows"] or 0
        t["needed"] = max(least, math.floor(share * sample_rows + 0.5))
        t["cell"] = (t["kind"] or "", t["prop"] or "")
        t["goal"] = max(float(least), share * sample_rows)
        goals[t["cell"]] += t["goal"]
        have[t["cell"]] = t["available"]
    # Minima come on top of the other categories' shares; what a category lacks is spread over those that have more.
    cells = {c: min(v, float(have[c])) for c, v in goals.items()}
    while (short := sample_rows - sum(cells.values())) > 1e-9:
        free = {c: v for c, v in cells.items() if 0 < v < have[c]}
        if not free:
            break
        grow = 1 + short / sum(free.values())
        cells |= {c: min(v * grow, float(have[c])) for c, v in free.items()}
    whole = controlled_rounding(cells) if cells else {}
    for c, total in whole.items():
        total = min(total, have[c])
        own = [t for t in targets if t["cell"] == c]
        # Targets of one category share what it gives, each as much as it asks for, the first ones the odd records.
        asks = sum(t["goal"] for t in own)
        for i, t in enumerate(own):
            t["quota"] = math.ceil(total * t["goal"] / asks) if asks and i < len(own) - 1 else total - sum(x["quota"] for x in own[:i])
            t["quota"] = min(t["quota"], total - sum(x["quota"] for x in own[:i]))
            t["unmet"] = total == have[c] and total < t["needed"]


def spread_over_cells(targets: list[dict], holds: dict[tuple, int]) -> dict[tuple[int, tuple], int]:
    """How many records each target draws of each cell ``(kind, prop)`` of its plan, no cell giving more than it holds.

    Quotas are spread in proportion to what cells hold; what a full cell cannot
    give is asked of the target's other cells.  Sets each target's ``quota`` to
    what it gets.
    """
    of = {}
    for i, t in enumerate(targets):
        if t["kind"] is not None or t["prop"] is not None:
            of[i] = [c for c, n in holds.items() if n and (t["kind"] is None or t["kind"] == c[0]) and (t["prop"] is None or t["prop"] == c[1])]
    take: dict[tuple, float] = defaultdict(float)
    room = {c: float(n) for c, n in holds.items()}
    lacks = {i: float(targets[i]["quota"]) for i in of}
    for _ in range(60):
        asked: dict[tuple, float] = {}
        for i, cells in of.items():
            open_ = sum(room[c] for c in cells)
            for c in cells if lacks[i] > 1e-9 and open_ > 1e-9 else ():
                asked[i, c] = min(lacks[i], open_) * room[c] / open_
        sums: dict[tuple, float] = defaultdict(float)
        for (_, c), v in asked.items():
            sums[c] += v
        if not asked:
            break
        for (i, c), v in asked.items():
            v *= min(1.0, room[c] / sums[c]) if sums[c] else 0.0
            take[i, c] += v
            lacks[i] -= v
        for c, v in sums.items():
            room[c] = max(0.0, room[c] - v)
    whole = controlled_rounding({k: v for k, v in take.items() if v > 1e-9}) if take else {}
    for i, t in enumerate(targets):
        t["quota"] = sum(n for (j, _), n in whole.items() if j == i)
    return {k: n for k, n in whole.items() if n}


def _planned(records: DataFrame, plans: DataFrame, targets: DataFrame) -> tuple[list[dict], list[tuple], dict]:
    """Targets with their quotas, what each draws of each cell, and the kinds and props each plan names."""
    once_each = once(records.select("row_id", term("kind").alias("kind_term"), term("prop").alias("prop_term")), "kind_term", "prop_term")
    goals = targets.join(plans, "plan_id").select(
        "plan_id", "target_id", term("kind").alias("kind"), term("prop").alias("prop"), "share", "min_rows", "sample_rows"
    )
    # Targets are given by hand, so their number is bounded by the plans; only they and one sum a cell reach the driver.
    by_plan: dict[int, list[dict]] = defaultdict(list)
    for r in goals.orderBy("plan_id", "target_id").collect():
        by_plan[r["plan_id"]].append(r.asDict())
    named = {p: tuple(tuple(sorted({t[k] for t in ts if t[k] is not None})) for k in ("kind", "prop")) for p, ts in by_plan.items()}
    counts = once_each.groupBy("kind_term", "prop_term").agg(F.count(F.lit(1)).alias("n"))
    holds: dict[int, dict[tuple, int]] = defaultdict(dict)
    if named:
        cells = counts.withColumn("cell", F.explode(_cells(named))).groupBy("cell").agg(F.sum("n").alias("n"))
        for r in cells.collect():
            holds[r["cell"]["plan_id"]][r["cell"]["kind"], r["cell"]["prop"]] = r["n"]
    draws = []
    for plan_id, own in by_plan.items():
        for t in own:
            fits = (n for (k, p), n in holds[plan_id].items() if (t["kind"] is None or k == t["kind"]) and (t["prop"] is None or p == t["prop"]))
            t["available"] = sum(fits) if t["kind"] is not None or t["prop"] is not None else 0
        quotas(own, own[0]["sample_rows"] or 0)
        for (i, (kind, prop)), n in sorted(spread_over_cells(own, holds[plan_id]).items(), key=repr):
            draws.append((plan_id, own[i]["target_id"], kind, prop, n))
    return [t for own in by_plan.values() for t in own], draws, named


def _cells(named: dict) -> Column:
    """A record's cell in each plan: its kind and prop where the plan's targets name them."""
    only = lambda c, terms: F.when(F.col(c).isin(*terms), F.col(c)) if terms else F.lit(None).cast("string")
    return F.array(*[F.struct(F.lit(p).alias("plan_id"), only("kind_term", ks).alias("kind"), only("prop_term", ps).alias("prop")) for p, (ks, ps) in named.items()])


def plan_report(records: DataFrame, plans: DataFrame, targets: DataFrame) -> DataFrame:
    """``(plan_id, target_id, kind_term, prop_term, available, needed, quota, unmet)`` of every target of every plan.

    ``needed`` is the greater of ``min_rows`` and share x sample_rows rounded to
    a whole number, ``quota`` what the sample draws; ``unmet`` where that takes
    all there is of a category and is less than needed.
    """
    columns = ("plan_id", "target_id", "kind", "prop", "available", "needed", "quota", "unmet")
    return records.sparkSession.createDataFrame(
        [tuple(t[c] for c in columns) for t in _planned(records, plans, targets)[0]],
        "plan_id int, target_id int, kind_term string, prop_term string, available bigint, needed bigint, quota bigint, unmet boolean",
    )


def draw_sample(records: DataFrame, plans: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """``(plan_id, target_id, row_id)``: of each target exactly ``quota`` records, none twice in a plan, those of the lowest random keys."""
    spark = records.sparkSession
    _, draws, named = _planned(records, plans, targets)
    spans, used = [], defaultdict(int)
    for plan_id, target_id, kind, prop, n in draws:
        at = used[plan_id, kind, prop]
        spans.append((plan_id, kind, prop, target_id, at, at + n))
        used[plan_id, kind, prop] = at + n
    # Made on the driver above, one row a target and cell: broadcast is bounded, and a hot category is no single task.
    table = spark.createDataFrame(spans, "span_plan int, span_kind string, span_prop string, target_id int, low bigint, high bigint")
    goals = spark.createDataFrame([(*k, n) for k, n in used.items()], "goal_plan int, goal_kind string, goal_prop string, quota bigint")
    base = once(records.select("row_id", term("kind").alias("kind_term"), term("prop").alias("prop_term")), "kind_term", "prop_term")
    base = base.where("kind_term is not null or prop_term is not null")
    cells = base.withColumn("cell", F.explode(_cells(named))) if named else base.withColumn("cell", F.lit(None).cast("struct<plan_id:int,kind:string,prop:string>"))
    cells = cells.select("row_id", "cell.plan_id", "cell.kind", "cell.prop")
    same = lambda side: (F.col("plan_id") == F.col(f"{side}_plan")) & F.col("kind").eqNullSafe(F.col(f"{side}_kind")) & F.col("prop").eqNullSafe(F.col(f"{side}_prop"))
    # Written once: bucket counts and rows both come from it.
    cells = cut(cells.join(F.broadcast(goals), same("goal")).select("row_id", "plan_id", "kind", "prop", "quota").withColumn("key", draw(seed, "plan_id", "row_id")))
    keys = ["plan_id", "kind", "prop"]
    drawn = lowest(cells, keys, "key", "row_id", "quota")
    placed = ranked(drawn, keys, "key", "row_id").join(F.broadcast(table), same("span") & (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high")))
    return placed.select("plan_id", "target_id", "row_id")

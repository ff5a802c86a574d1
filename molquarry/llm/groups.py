"""Splits that keep related records together (problem 3).

Records refer to molecules; molecules that share a record are linked, and a
table of parents is hooked and shortcut until it names each molecule's
component.  Groups are counted by size, and subset-sum bitsets over the sizes'
multiplicities choose how many groups of each size go to each split.

Scale: links are distinct molecule pairs; each round at least halves the
molecules that still have links, and works on what is left.  Counts are
aggregated before any shuffle by group.  Joins on a name, a spelling, a parent
or a root deal the rows of hot keys over all tasks.  What reaches the driver is one row per
distinct group size (at most the square root of twice the records).  Groups of
equal size are ranked by bucketed random keys, never sorted in one task.

Defined results: rows without ``row_id`` are no records, deliveries count
once; unreadable SMILES and unknown names refer to nothing; records that refer
to nothing are groups of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.molecules import counted_molecules, name_spellings
from ..functions.ranking import ranked
from ..functions.text import plain_smiles, term
from ..runtime import cut, draw, hot_keys, spread_join
from .records import once, pair_refs, question_spellings

SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))
#: Most records that bitsets place.
BITS = 1 << 20


def references(
    records: DataFrame, name_dict: DataFrame, controls: DataFrame, positioned: tuple[DataFrame, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(row_id, node)``: the molecules each record refers to, and ``(node, pos)`` of tables ``(pos, smiles)``.

    A node is a number that stands for a molecule.  The kernel runs once over
    the spellings of all tables.
    """
    spelled = F.when(
        F.col("smiles").isNull() & F.col("pairs").isNull() & F.col("name").isNull(), question_spellings()
    ).otherwise(
        F.concat(F.array(plain_smiles("smiles")), F.coalesce(F.transform(pair_refs(), lambda p: p["spelling"]), F.array().cast("array<string>")))
    )
    base = records.where("row_id is not null")
    spellings = base.select("row_id", F.explode(spelled).alias("spelling")).where("spelling is not null")
    named = name_spellings(name_dict, controls)
    places = None
    for t in positioned:
        part = t.select("pos", plain_smiles("smiles").alias("spelling"))
        places = part if places is None else places.unionByName(part)
    every = spellings.select("spelling").unionByName(named.select("spelling"))
    if places is not None:
        every = every.unionByName(places.select("spelling"))
    known = cut(counted_molecules(every))
    # Written, so that each molecule keeps its number.
    nodes = cut(known.select("molecule").distinct().withColumn("node", F.monotonically_increasing_id()))
    known = cut(known.join(nodes, "molecule").select("spelling", "node", "n"))
    by_text = spread_join(spellings, known.drop("n"), "spelling", hot_keys(known, "spelling"), "row_id").select("row_id", "node")
    asked = base.select("row_id", term("name").alias("name_term")).where("name_term is not null")
    often = asked.groupBy("name_term").agg(F.count(F.lit(1)).alias("n"))
    names = named.join(known, "spelling").where("name_term is not null").groupBy("name_term").agg(F.min_by("node", "_from").alias("node"))
    by_name = spread_join(asked, names, "name_term", hot_keys(often, "name_term"), "row_id").select("row_id", "node")
    refs = by_text.unionByName(by_name).distinct()
    pos = places.join(known, "spelling").groupBy("node").agg(F.min("pos").alias("pos")) if places is not None else None
    return refs, pos


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; ``root`` is the smallest node of its component.

    Hooking: each root takes the smallest root it is linked to, if that is
    smaller.  Shortcutting: parents are replaced by their parents until all
    point at roots.  Links are then renamed to roots and made distinct, so each
    round works on the links that are left.  The tables of all rounds are
    composed from the last to the first, each node once.
    """
    links = cut(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("parent"))
        hooks = _shortcut(cut(hooks))
        rounds.append(hooks)
        # A giant component's root may be linked to most others: both ends are renamed with its links dealt out.
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        hot = hot_keys(degree, "a")
        left = spread_join(links, hooks.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a", hot, "b")
        left = spread_join(left, hooks.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b", hot, "a").where("pa <> pb")
        links = cut(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("parent").alias("root"))
    for earlier in reversed(rounds[:-1]):
        up = roots.select(F.col("node").alias("parent"), "root")
        roots = cut(spread_join(earlier, up, "parent", _hot_parents(earlier), "node", "left").select("node", F.coalesce("root", "parent").alias("root")))
    return roots


def _hot_parents(hooks: DataFrame) -> list:
    return hot_keys(hooks.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent")


def _shortcut(hooks: DataFrame) -> DataFrame:
    """``(node, parent)`` with every parent a root; ``hooks`` is written and holds each parent as a node too."""
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        short = spread_join(hooks, up, "parent", _hot_parents(hooks), "node")
        short = cut(short.select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        hooks = short.select("node", "parent")
        if short.where("moved").isEmpty():
            return hooks


def record_groups(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From written ``(row_id, node)``: ``(row_id, root)`` of each record, and ``(node, root)`` of each molecule linked to another."""
    firsts = refs.groupBy("row_id").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
    several = firsts.where("n > 1").select("row_id", "first")
    roots = components(refs.join(several, "row_id").select(F.col("first").alias("a"), F.col("node").alias("b")))
    named = firsts.select("row_id", F.col("first").alias("node"))
    popular = hot_keys(named.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node")
    rows = spread_join(named, roots, "node", popular, "row_id", "left")
    return rows.select("row_id", F.coalesce("root", "node").alias("root")), roots


def related(records: DataFrame, molecules: DataFrame, name_dict: DataFrame, controls: DataFrame) -> DataFrame:
    """``(row_id, group_pos)`` of the records in groups of two or more; null where no molecule of the group has a ``pos``."""
    refs, pos = references(records, name_dict, controls, (molecules, controls.select("pos", "smiles")))
    rows, roots = record_groups(cut(refs))
    rows = cut(rows)
    lowest = pos.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("pos").alias("group_pos"))
    sizes = cut(rows.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1").join(lowest, "root", "left"))
    return spread_join(rows, sizes.drop("size"), "root", hot_keys(sizes, "root", "size"), "row_id").select("row_id", "group_pos")


def _subset(sizes: dict[int, int], goal: int) -> dict[int, int]:
    """Counts per size whose total is nearest ``goal``, by subset-sum bitsets over binary parts of the multiplicities."""
    parts = []
    for s in sorted((s for s, n in sizes.items() if n and s <= 2 * goal), reverse=True):
        n, k = min(sizes[s], 2 * goal // s), 1
        while n:
            k = min(k, n)
            parts.append((s, k))
            n -= k
            k *= 2
    keep = (1 << (2 * goal + 1)) - 1
    reach = [1]
    for s, k in parts:
        reach.append((reach[-1] | reach[-1] << s * k) & keep if s * k <= 2 * goal else reach[-1])
    at = next(g for d in range(goal + 1) for g in (goal - d, goal + d) if reach[-1] >> g & 1)
    taken: dict[int, int] = {}
    for i in range(len(parts), 0, -1):
        if not reach[i - 1] >> at & 1:
            s, k = parts[i - 1]
            taken[s] = taken.get(s, 0) + k
            at -= s * k
    return taken


def choose_sizes(sizes: dict[int, int], shares: list[float], bits: int = BITS) -> list[dict[int, int]]:
    """How many groups of each size go to each share, the last share taking the rest.

    Up to ``bits`` records are placed by bitsets alone.  Of more, the groups of
    the largest sizes are first dealt out in proportion to what each share
    still lacks, odd ones to the share that lacks most, until so many are left.
    """
    left = {s: n for s, n in sizes.items() if n}
    records = sum(s * n for s, n in left.items())
    lacks = [round(share * records) for share in shares[:-1]]
    lacks.append(records - sum(lacks))
    out: list[dict[int, int]] = [{} for _ in shares]

    def place(i: int, s: int, k: int) -> None:
        if k:
            out[i][s] = out[i].get(s, 0) + k
            lacks[i] -= s * k
            left[s] -= k

    rest = records
    for s in sorted(left, reverse=True):
        if rest <= bits:
            break
        rest -= s * left[s]
        open_ = [max(0, x) for x in lacks]
        dealt = [left[s] * x // max(1, sum(open_)) for x in open_]
        for i, k in enumerate(dealt):
            place(i, s, k)
        while left[s]:
            place(max(range(len(lacks)), key=lacks.__getitem__), s, 1)
    for i in range(len(shares) - 1):
        if lacks[i] > 0:
            for s, k in _subset(left, lacks[i]).items():
                place(i, s, k)
    for s, n in list(left.items()):
        place(len(shares) - 1, s, n)
    return out


def grouped_split(
    records: DataFrame, name_dict: DataFrame, controls: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS, seed: int = 7
) -> DataFrame:
    """``(row_id, new_split)`` of all records; records that share a molecule, directly or not, have one split."""
    spark = records.sparkSession
    refs, _ = references(records, name_dict, controls)
    rows, _ = record_groups(cut(refs))
    # Records that refer to nothing are groups of their own, named apart from the molecules' numbers.
    root = F.coalesce(F.concat(F.lit("molecule "), "root"), F.concat(F.lit("row "), "row_id"))
    grouped = cut(once(records).join(rows, "row_id", "left").withColumn("root", root))
    groups = cut(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("size")).withColumn("key", draw(seed, "root")))
    sizes = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = choose_sizes(sizes, [share for _, share in splits])
    spans, used = [], dict.fromkeys(sizes, 0)
    for (label, _), taken in zip(splits, plan):
        for s, k in taken.items():
            spans.append((s, used[s], used[s] + k, label))
            used[s] += k
    table = spark.createDataFrame(spans, "span_size bigint, low bigint, high bigint, new_split string")
    placed = ranked(groups, ["size"], "key", "root")
    # One row per split and distinct group size, made on the driver above: broadcast is bounded, and groups of one record,
    # which may be most of all, are no single join key's task.
    on = (F.col("size") == F.col("span_size")) & (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high"))
    named = placed.join(F.broadcast(table), on).select("root", "new_split")
    return spread_join(grouped, named, "root", hot_keys(groups, "root", "size"), "row_id").select("row_id", "new_split")

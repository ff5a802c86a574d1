"""Filling containers of fixed capacity (problem 5), by bin completion.

Texts longer than the capacity are divided into full pieces and a rest; full
pieces fill a container each.  Texts and rests are hashed into blocks of equal
expected size, and each block is packed on the multiset of its sizes: around
the largest size left, undominated fillings of the remaining space are
enumerated, fullest first; a branch is cut when its waste exceeds what an
improvement on the incumbent allows.  The incumbent starts as best fit
decreasing.

Scale: tokenizing is one pass without a shuffle; one shuffle moves ids and
sizes to their blocks.  A block is bounded (``BLOCK`` items expected), so that no
task grows with the data; blocks cost at most one badly filled container each.

Defined results: null and empty texts have no tokens and no container; blank
texts have tokens; repeated rows of one ``doc_id`` are texts of their own,
numbered by ``copy``; a null or non-positive capacity is left out; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, ship, width
from .tokens import TOKENIZER, token_sizes

#: Items expected in a block.
BLOCK = 8192
#: Effort of the search in a block, beyond which the incumbent stands: branches taken back, and sizes looked at in enumerating fillings.
NODES = 400
STEPS = 1_000_000


def best_fit(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Containers by best fit decreasing, each a list of sizes."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            at = bisect_right(rooms, size - 1)
            if at < len(rooms):
                room = rooms[at]
                b = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
                bins[b].append(size)
                room -= size
            else:
                b = len(bins)
                bins.append([size])
                room = capacity - size
            if room:
                if room not in by_room:
                    by_room[room] = []
                    insort(rooms, room)
                by_room[room].append(b)
    return bins


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs: for each cut-off, those of large items plus what cannot sit beside them."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    large = [s for s in sizes if 2 * s > capacity]
    n_large = sum(counts[s] for s in large)
    best = max(best, n_large)
    for k in {capacity - s for s in large if capacity - s} | {s for s in sizes if 2 * s <= capacity}:
        if 2 * k > capacity:
            continue
        one = sum(counts[s] for s in sizes if s > capacity - k)
        two = [s for s in sizes if capacity - k >= s > capacity / 2]
        three = sum(s * counts[s] for s in sizes if capacity / 2 >= s >= k)
        n_two = sum(counts[s] for s in two)
        room = n_two * capacity - sum(s * counts[s] for s in two)
        best = max(best, one + n_two + max(0, -(-(three - room) // capacity)))
    return best


def fillings(sizes: list[int], counts: dict[int, int], room: int, slack: int, effort: list[int] | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room`` leaving at most ``slack``, fullest first and then with the largest items first.

    ``sizes`` is the ascending list of sizes left and ``counts`` how many of
    each; both must be as they were whenever the next way is asked for.  A way
    is descending.  One of whose items several together are as large as a single
    item left over is dominated by the way with that item, which is among the
    ways of the same total.  ``effort`` counts the sizes that may still be looked
    at; the enumeration ends with it.
    """
    effort = effort if effort is not None else [STEPS]
    small = sizes[: bisect_right(sizes, room)]
    if not small:
        if room <= slack:
            yield ()
        return
    # Bit t of reach[k] tells whether the k smallest sizes can make t, so that no search runs into a dead end.
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for s in small:
        bits, n, k = reach[-1], min(counts[s], room // s), 1
        while n:
            k = min(k, n)
            bits |= bits << s * k & mask
            n -= k
            k *= 2
        reach.append(bits)

    def exactly(total: int, top: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Ways of one total from the ``top`` smallest sizes, beside those already taken."""
        for k in range(top, 0, -1):
            if not reach[k] >> total & 1:
                return
            effort[0] -= 1
            if effort[0] < 0:
                return
            s = small[k - 1]
            if s <= total and counts[s] > taken.count(s):
                if s == total:
                    yield (*taken, s)
                else:
                    yield from exactly(total - s, min(k, bisect_right(small, total - s)), (*taken, s))

    if not room:
        yield ()
        return
    for total in range(room, max(0, room - slack) - 1, -1):
        if not total:
            yield ()
        elif reach[-1] >> total & 1:
            for way in exactly(total, bisect_right(small, total), ()):
                if len(way) < 2 or not _dominated(way, counts):
                    yield way


def _dominated(way: tuple[int, ...], counts: dict[int, int]) -> bool:
    """Whether two items or more of a way are together as large as a single one left over."""
    sums = {0: 0}  # sum -> most items in it, one or several
    for s in way:
        for total, n in list(sums.items()):
            sums[total + s] = max(sums.get(total + s, 0), n + 1)
    return any(n > 1 and counts.get(total, 0) > way.count(total) for total, n in sums.items())


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES, steps: int = STEPS) -> list[list[int]]:
    """Containers by bin completion branch and bound over a multiset of sizes, all at most ``capacity``.

    The search ends when the lower bound is met, everything is searched, or
    ``nodes`` branches have been taken back or ``steps`` sizes looked at; what
    it has by then, best fit at worst, is returned.
    """
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    if len(best) <= bound:
        return best
    total = sum(s * n for s, n in counts.items())
    left = dict(counts)
    sizes = sorted(left)

    def take(s: int) -> None:
        left[s] -= 1
        if not left[s]:
            del left[s]
            sizes.pop(bisect_right(sizes, s) - 1)

    def give(s: int) -> None:
        if s not in left:
            left[s] = 0
            insort(sizes, s)
        left[s] += 1

    levels: list[tuple[int, Iterator[tuple[int, ...]], tuple[int, ...] | None]] = []  # largest, fillings to come, the one taken
    waste = 0
    seen = 0
    effort = [steps]
    forward = True
    while True:
        allowed = (len(best) - 1) * capacity - total
        if forward:
            forward = False
            if not sizes:
                best = [[big, *way] for big, _, way in levels]
                if len(best) <= bound:
                    return best
                continue
            big = sizes[-1]
            take(big)
            levels.append((big, fillings(sizes, left, capacity - big, allowed - waste, effort), None))
        # Next filling of the last level.
        if not levels:
            return best
        big, ways, way = levels.pop()
        if way is not None:
            seen += 1
            for s in way:
                give(s)
            waste -= capacity - big - sum(way)
        if seen > nodes or effort[0] < 0:
            return best
        way = next(ways, None)
        # Fillings come fullest first: after one that wastes too much all do.
        if way is None or waste + capacity - big - sum(way) > allowed:
            give(big)
            continue
        for s in way:
            take(s)
        waste += capacity - big - sum(way)
        levels.append((big, ways, way))
        forward = True


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """Number the containers of one block."""
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["doc_id", "copy", "piece"], kind="stable")
    sizes = pdf["tokens"].to_numpy()
    places: dict[int, list[int]] = {}
    for i, s in enumerate(sizes.tolist()):
        places.setdefault(s, []).append(i)
    slot = [0] * len(pdf)
    for number, content in enumerate(complete(dict(Counter(sizes.tolist())), capacity)):
        for s in content:
            slot[places[s].pop()] = number
    out = pdf[["container_id", "capacity", "doc_id", "copy", "piece", "tokens", "block"]].copy()
    out["slot"] = slot
    return out


def pack_documents(documents: DataFrame, containers: DataFrame, path: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """Container of each text or piece, for each kind of container.

    ``(container_id, capacity, block, slot, doc_id, copy, piece, tokens)``:
    ``block`` and ``slot`` name a container of a kind (``block`` -1: a full piece
    of its own, ``slot`` null); ``piece`` counts from 0 and starts at token
    ``piece * capacity``.
    """
    ship(documents.sparkSession)
    kinds = [
        (r["container_id"], r["capacity"])
        for r in containers.where("capacity > 0").select("container_id", "capacity").distinct().collect()
    ]  # the kinds of container on offer, a few
    kind_type = "array<struct<container_id:int,capacity:int>>"
    array = F.array(*[F.struct(F.lit(i).alias("container_id"), F.lit(c).alias("capacity")) for i, c in kinds]).cast(kind_type)
    sizes = cut(token_sizes(documents, "doc_id", path=path))
    n = sizes.count()
    sizes = sizes.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("tokens")) - 1)
    every = sizes.withColumn("kind", F.explode(array)).select(
        "doc_id", "copy", F.col("tokens").alias("whole"), "kind.container_id", "kind.capacity"
    )
    cap = F.col("capacity").cast("bigint")
    last = F.floor((F.col("whole") - 1) / cap)
    pieces = every.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn(
        "tokens", F.least(cap, F.col("whole") - F.col("piece") * cap)
    )
    blocks = max(1, -(-n // block))
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(blocks)))
    columns = ["container_id", "capacity", "doc_id", "copy", "piece", "tokens", "block"]
    schema = "container_id int, capacity int, doc_id bigint, copy int, piece bigint, tokens bigint, block bigint, slot int"
    full = placed.where(F.col("tokens") == cap).select(*columns).withColumns({"block": F.lit(-1).cast("bigint"), "slot": F.lit(None).cast("int")})
    # A number of partitions of our own: blocks cost Python time, not bytes.
    rest = placed.where(F.col("tokens") < cap).select(*columns).repartition(width(documents.sparkSession), "container_id", "block")
    packed = rest.groupBy("container_id", "block").applyInPandas(_pack, schema)
    return packed.unionByName(full).select("container_id", "capacity", "block", "slot", "doc_id", "copy", "piece", "tokens")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind of container: containers used, tokens packed, and the fraction of space left unused."""
    used = packed.groupBy("container_id", "capacity", "block", "slot").agg(
        F.when(F.col("block") == -1, F.count(F.lit(1))).otherwise(1).alias("n"), F.sum("tokens").alias("tokens")
    )
    return used.groupBy("container_id", "capacity").agg(F.sum("n").alias("containers"), F.sum("tokens").alias("tokens")).withColumn(
        "unused", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)
    )


def divided(packed: DataFrame) -> DataFrame:
    """``(doc_id)`` of texts that were divided."""
    return packed.where("piece > 0").select("doc_id").distinct()

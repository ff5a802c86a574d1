"""Same or near-same records across splits (problem 1).

Each record becomes an *anchor* (what must agree: kind term, molecule and prop
term, or the numbers of a question) and a *text* (its normalised wording).
Equal (anchor, text) form one class, known by a digest.  For single, error,
multi and chain wording does not matter, so the anchor is all there is: two
records are the same or they are not, and the whole record is one chunk.

The questions of no_tool and clarify are cut by a rolling hash into
content-defined chunks; chunk digests, which include the anchor, are joined
across splits and the shared chunk lengths summed into overlap fractions.

Scale: records are narrowed to digests before anything is joined.  Classes that
lie on one side only, and questions alone with their numbers, leave before
chunking.  The digest join is restricted to each text's rarest chunks (prefix
filter), which loses no pair at or above the threshold unless one text is more
than twice as long as the other.  A digest with many classes is cut into a grid
of blocks, so no task joins more than a block with a block.  No group is
collected or sorted in one task.

Below the threshold, where slips have destroyed most chunks of a short text,
candidates come from an exact join: of three pieces of a text, two slips leave
one whole (``piece_keys``).  So every pair of an anchor within ``SLIPS`` is
found, at any length.

Defined results: null ``row_id`` or ``split`` forms no case; redelivered
records count once; null kind, other kinds, a null prop term or an unreadable
molecule where one is needed form no case; blank questions form no case; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.molecules import counted_molecules, named_molecules
from ..functions.text import fold, no_blanks, plain_smiles, term
from ..runtime import cut, hot_keys, python_map, spread_join, width
from .records import pair_refs

# Courtesies that open or close a question.
OPENERS = (
    "hi", "hello", "hey", "dear all", "dear colleague", "good morning", "good afternoon", "good evening", "q", "question",
    "quick one", "quick question", "ok so", "okay so", "ok", "okay", "so", "please", "kindly", "one more thing", "excuse me", "sorry",
    "hallo", "guten tag", "bitte", "bonjour", "salut", "hola", "buenos dias", "buenos días", "por favor",
)
CLOSERS = (
    "thanks", "thank you", "thank you very much", "thank you in advance", "thanks in advance", "thanks a lot", "many thanks", "thx", "ty",
    "please", "cheers", "danke", "vielen dank", "danke im voraus", "merci", "merci d avance", "gracias", "muchas gracias",
)

CHUNK_LEAST = 3
CHUNK_MASK = 0b11
CHUNK_MOST = 32
#: Least shared fraction of the shorter text for a candidate pair of the chunk join.
OVERLAP = 0.5
#: Most classes of one side and digest that meet in one task.
GRID = 4096
#: Slips of the pen in a pair of questions (one on either side).
SLIPS = 2


def bare_question(question: Column | str = "question") -> Column:
    """A question without courtesies, case, punctuation, blanks beyond single ones, width and invisible characters."""
    text = F.trim(F.regexp_replace(F.lower(fold(question)), r"[^\p{L}\p{N}]+", " "))
    opener = "|".join(sorted(OPENERS, key=len, reverse=True))
    closer = "|".join(sorted(CLOSERS, key=len, reverse=True))
    text = F.regexp_replace(text, rf"^(?:(?:{opener})(?: |$))+", "")
    text = F.regexp_replace(text, rf"(?:(?:^| )(?:{closer}))+$", "")
    return F.when(text != "", text)


def _gear() -> list[int]:
    """A table of 256 pseudo-random 32-bit values from a linear congruential rule."""
    x, out = 0x9E3779B9, []
    for _ in range(256):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(x ^ (x >> 15))
    return out


_GEAR = _gear()


def chunks(text: str, least: int = CHUNK_LEAST, mask: int = CHUNK_MASK, most: int = CHUNK_MOST) -> list[str]:
    """Content-defined chunks: cut where the rolling hash of the last four characters has its masked bits clear."""
    out, start, h = [], 0, 0
    for i, c in enumerate(text):
        h = ((h << 8) & 0xFFFFFFFF) ^ _GEAR[ord(c) & 0xFF]
        mixed = (h ^ (h >> 7) ^ (h >> 17)) * 0x9E3779B1 >> 13
        n = i + 1 - start
        if (n >= least and not mixed & mask) or n >= most:
            out.append(text[start : i + 1])
            start = i + 1
    if start < len(text):
        out.append(text[start:])
    return out


def _chunk_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of texts, equal ones of a text numbered."""
    for pdf in batches:
        ids, anchors, texts, numbers, sides, totals = [], [], [], [], [], []
        for class_id, anchor, text, side in zip(pdf["class_id"], pdf["anchor"], pdf["text"], pdf["sides"]):
            seen: dict[str, int] = {}
            for c in chunks(text):
                seen[c] = seen.get(c, 0) + 1
                ids.append(class_id)
                anchors.append(anchor)
                texts.append(c)
                numbers.append(seen[c])
                sides.append(side)
                totals.append(len(text))
        yield pd.DataFrame({"class_id": ids, "anchor": anchors, "chunk": texts, "no": numbers, "sides": sides, "total": totals})


def _layout(n: int, slips: int) -> list[tuple[int, int]]:
    """Start and end of ``slips + 1`` pieces of a text of length n, one character between neighbours, so that a swap breaks one only."""
    room = max(0, n - slips)
    cuts = [room * i // (slips + 1) for i in range(slips + 2)]
    return [(min(n, a + i), min(n, b + i)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def piece_keys(text: str, slips: int = SLIPS) -> list[str]:
    """Keys of a text: each of its pieces with the text's length and the piece's number."""
    return [f"{len(text)} {i} {text[a:b]}" for i, (a, b) in enumerate(_layout(len(text), slips))]


def probe_keys(text: str, slips: int = SLIPS) -> list[str]:
    """Keys one of which is among the ``piece_keys`` of any text at most ``slips`` away.

    A slip breaks one piece at most, so one is left, shifted by the characters
    put in less those left out before it; those behind it make up the rest of
    the difference in length, and both together are no more than ``slips``.
    """
    out: dict[str, None] = {}
    for more in range(-slips, slips + 1):
        n = len(text) - more
        if n < 0:
            continue
        for i, (a, b) in enumerate(_layout(n, slips)):
            for shift in range(-slips, slips + 1):
                if abs(shift) + abs(more - shift) <= slips and 0 <= a + shift and b + shift <= len(text):
                    out[f"{n} {i} {text[a + shift : b + shift]}"] = None
    return list(out)


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of texts without blanks; ``probe`` tells those of classes outside train from those of classes in it."""
    for pdf in batches:
        ids, anchors, keys, probes = [], [], [], []
        for class_id, anchor, text, side in zip(pdf["class_id"], pdf["anchor"], pdf["text"], pdf["sides"]):
            bare = text.replace(" ", "")
            for probe, own in ((False, piece_keys(bare) if side & 1 else []), (True, probe_keys(bare) if side & 2 else [])):
                ids += [class_id] * len(own)
                anchors += [anchor] * len(own)
                keys += own
                probes += [probe] * len(own)
        yield pd.DataFrame({"class_id": ids, "anchor": anchors, "key": keys, "probe": probes})


def slips(a: str, b: str, most: int = SLIPS) -> int | None:
    """Fewest insertions, deletions, changes and swaps of neighbours that lead from one text to another, or None above ``most``.

    Slips may meet: letters may be put between swapped ones or taken from there,
    as when either text has its own slip at one place.  Only the cells near the
    diagonal that ``most`` slips can reach are filled.
    """
    if abs(len(a) - len(b)) > most:
        return None
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    i, j = len(a), len(b)
    while i > lo and j > lo and a[i - 1] == b[j - 1]:
        i -= 1
        j -= 1
    a, b = a[lo:i], b[lo:j]
    far = most + 1
    rows = [{y: y for y in range(min(len(b), most) + 1)}]
    seen: dict[str, int] = {}  # last row of each letter of a
    for x, ca in enumerate(a, 1):
        before = rows[-1]
        row = {0: x} if x <= most else {}
        met = 0  # last column of this letter in b
        for y in range(max(1, x - most), min(len(b), x + most) + 1):
            cb = b[y - 1]
            d = min(before.get(y, far) + 1, row.get(y - 1, far) + 1, before.get(y - 1, far) + (ca != cb))
            up = seen.get(cb, 0)
            if up and met and x - up + y - met <= far:
                d = min(d, rows[up - 1].get(met - 1, far) + x - up + y - met - 1)
            if ca == cb:
                met = y
            if d <= most:
                row[y] = d
        seen[ca] = x
        rows.append(row)
        if not any(rows[-far:]):  # a swap reaches back so many rows
            return None
    return rows[-1].get(len(b))


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact check of candidates: the letters, without blanks, differ by slips of the pen at most."""
    for pdf in batches:
        keep = [slips(a.replace(" ", ""), b.replace(" ", "")) is not None for a, b in zip(pdf["text_a"], pdf["text_b"])]
        yield pdf.loc[keep, ["class_a", "class_b", "overlap"]]


def _grid_join(rows: DataFrame, key: str, first: Column, second: Column) -> DataFrame:
    """``(class_a, class_b)`` of different classes that share a ``key``: one for which ``first`` holds and one for which ``second`` does.

    Classes of one key are cut into blocks of ``GRID``; each block of one side
    meets each block of the other in a place of its own.
    """
    counts = rows.groupBy(key).agg(F.count_if(first).alias("_a"), F.count_if(second).alias("_b")).where("_a > 0 and _b > 0")
    blocks = lambda n: F.ceil(F.col(n) / GRID).cast("bigint")
    sized = rows.join(counts.select(key, blocks("_a").alias("_a"), blocks("_b").alias("_b")), key)
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n))
    a = sized.where(first).select(key, F.col("class_id").alias("class_a"), place("_a").alias("_x"), F.explode(every("_b")).alias("_y"))
    b = sized.where(second).select(key, F.col("class_id").alias("class_b"), F.explode(every("_a")).alias("_x"), place("_b").alias("_y"))
    return a.join(b, [key, "_x", "_y"]).where("class_a <> class_b").select("class_a", "class_b")


def _near(live: DataFrame) -> DataFrame:
    """``(class_a, class_b)`` candidates among which are all different texts of an anchor within ``SLIPS``, whatever chunks they share."""
    keys = python_map(
        live.select("class_id", "anchor", "text", "sides").repartition(width(live.sparkSession), F.xxhash64("class_id")),
        _key_rows, "class_id binary, anchor binary, key string, probe boolean",
    ).select("class_id", "probe", F.xxhash64("anchor", "key").alias("key"))
    return _grid_join(cut(keys), "key", ~F.col("probe"), F.col("probe")).distinct()


def _with_texts(pairs: DataFrame, live: DataFrame) -> DataFrame:
    texts = live.select("class_id", "text")
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("class_id").alias(f"class_{side}"), F.col("text").alias(f"text_{side}")), f"class_{side}")
    return pairs


def _digest(*parts: Column | str) -> Column:
    """Sixteen bytes that stand for some texts."""
    return F.unhex(F.md5(F.concat_ws("\u001e", *parts)))


def normalised(records: DataFrame, name_dict: DataFrame, controls: DataFrame) -> DataFrame:
    """``(row_id, split, source, anchor, text)`` of all records that can form a case, redelivered ones as often as they come.

    ``anchor`` is a digest.  Records of kind single, error, multi and chain are
    anchored by what they are about, so that wording does not matter, and their
    ``text`` is null; the questions of no_tool and clarify records are anchored
    by their numbers.
    """
    base = (
        records.where("row_id is not null and split is not null")
        .withColumn("kind_term", term("kind"))
        .where(F.col("kind_term").isin("single", "error", "multi", "chain", "no tool", "clarify"))
        .select("row_id", "split", "source", "kind_term", "question", "smiles", "pairs", "name", term("prop").alias("prop_term"))
    )
    who = ["row_id", "split", "source"]

    def about(df: DataFrame, *parts: Column | str) -> DataFrame:
        return df.select(*who, _digest("kind_term", *parts).alias("anchor"), F.lit(None).cast("string").alias("text"))

    single = base.where("kind_term = 'single' and prop_term is not null").select(*who, "kind_term", "prop_term", plain_smiles("smiles").alias("spelling"))
    multi = base.where("kind_term = 'multi'").select(*who, "kind_term", F.size("pairs").alias("size"), F.explode(pair_refs()).alias("ref"))
    multi = multi.select(*who, "kind_term", "size", "ref.spelling", "ref.prop_term").where("spelling is not null and prop_term is not null")
    single = single.where("spelling is not null")
    # The kernel runs once over the spellings of both.
    known = cut(counted_molecules(single.select("spelling").unionByName(multi.select("spelling"))))
    popular, known = hot_keys(known, "spelling"), known.drop("n")
    single = about(spread_join(single, known, "spelling", popular, "row_id"), "molecule", "prop_term")
    # A record with a pair that names no molecule or no prop is no case: all of its pairs must have come through the join.
    # The deliveries of a record are told apart by nothing, so their pairs are counted together.
    multi = spread_join(multi, known, "spelling", popular, "row_id").groupBy("row_id").agg(
        F.min("split").alias("split"), F.min("source").alias("source"), F.min("kind_term").alias("kind_term"), F.min("size").alias("size"),
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.concat_ws(" ", "molecule", "prop_term"))).alias("about"),
    )
    deliveries = base.where("kind_term = 'multi'").groupBy("row_id").agg(F.count(F.lit(1)).alias("times"))
    multi = about(multi.join(deliveries, "row_id").where("n = size * times"), F.array_join("about", "\u001f"))

    errors = about(base.where("kind_term = 'error' and smiles is not null and prop_term is not null"), no_blanks("smiles"), "prop_term")
    chains = base.where("kind_term = 'chain' and prop_term is not null").withColumn("name_term", term("name")).where("name_term is not null")
    chains = chains.select(*who, "kind_term", "prop_term", "name_term")
    often = chains.groupBy("name_term").agg(F.count(F.lit(1)).alias("n"))
    chains = spread_join(chains, named_molecules(name_dict, controls), "name_term", hot_keys(often, "name_term"), "row_id", "left")
    chains = about(chains, F.coalesce(F.concat(F.lit("molecule "), "molecule"), F.concat(F.lit("name "), "name_term")), "prop_term")
    asked = base.where(F.col("kind_term").isin("no tool", "clarify")).withColumn("text", bare_question()).where("text is not null")
    numbers = F.array_join(F.regexp_extract_all("text", F.lit(r"(\p{N}+)"), 1), " ")
    asked = asked.select(*who, _digest("kind_term", numbers).alias("anchor"), "text")
    return single.unionByName(multi).unionByName(errors).unionByName(chains).unionByName(asked)


def cross_split_overlap(rows: DataFrame, train: str = "train", overlap: float = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Class pairs that overlap across splits, and the membership of all records.

    ``rows``: ``(row_id, split, source, anchor, text)`` as ``normalised`` gives
    them; a null text stands for an anchor that says everything.  Returns

    * ``(class_a, class_b, overlap)``: a class with records in ``train`` and one
      with records elsewhere (the same class for exact copies), and the
      fraction of the shorter text in shared chunks;
    * ``(class_id, row_id, split, source)``, deliveries of a record as often as
      they come.
    """
    spark = rows.sparkSession
    # Written once: classes and members both come from it, and behind it lies the molecule kernel.
    rows = cut(rows.withColumn("class_id", F.coalesce(F.unhex(F.md5(F.concat(F.hex("anchor"), "text"))), "anchor")))
    members = rows.select("class_id", "row_id", "split", "source")
    is_train = (F.col("split") == train).cast("int")
    sides = (F.max(is_train) + 2 * F.max(1 - is_train)).alias("sides")  # 1: only train, 2: only other splits, 3: both
    same = rows.groupBy("class_id").agg(sides).where("sides = 3")
    same = same.select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), F.lit(1.0).alias("overlap"))
    # Questions: texts beside others of the same numbers on the other side.
    texts = rows.where("text is not null").groupBy("class_id").agg(F.min("anchor").alias("anchor"), F.min("text").alias("text"), sides)
    texts = cut(texts)
    meet = texts.groupBy("anchor").agg(F.bit_or("sides").alias("s"), F.count(F.lit(1)).alias("n")).where("s = 3 and n > 1").select("anchor")
    live = cut(texts.join(meet, "anchor", "left_semi"))
    pieces = python_map(
        live.select("class_id", "anchor", "text", "sides").repartition(width(spark), F.xxhash64("class_id")),
        _chunk_rows, "class_id binary, anchor binary, chunk string, no int, sides int, total int",
    )
    pieces = pieces.select("class_id", "sides", "total", F.length("chunk").alias("size"), F.xxhash64("anchor", "chunk", "no").alias("digest"))
    # The number of classes with a digest, for the order of rarity; only digests of both sides can join.
    pieces = cut(pieces)
    rare = pieces.groupBy("digest").agg(F.count(F.lit(1)).alias("df"), F.bit_or("sides").alias("s")).where("s = 3").select("digest", "df")
    shared = cut(pieces.join(rare, "digest"))
    # Rarest chunks first: the rarest chunk a pair shares has at least the pair's shared length at or behind it in
    # either text, so it lies in the prefixes below (for texts of which none is more than twice as long as the other).
    rest = Window.partitionBy("class_id").orderBy("df", "digest").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    prefix = shared.withColumn("rest", F.sum("size").over(rest)).where(F.col("rest") >= F.lit(overlap / 2) * F.col("total"))
    prefix = cut(prefix.select("digest", "class_id", "sides"))
    by_chunks = _grid_join(prefix, "digest", F.col("sides").isin(1, 3), F.col("sides").isin(2, 3))
    candidates = by_chunks.withColumn("near", F.lit(False)).union(_near(live).withColumn("near", F.lit(True)))
    candidates = candidates.groupBy("class_a", "class_b").agg(F.max("near").alias("near"))
    left = shared.select("digest", "size", F.col("total").alias("total_a"), F.col("class_id").alias("class_a"))
    right = shared.select("digest", F.col("total").alias("total_b"), F.col("class_id").alias("class_b"))
    # Near texts may share no chunk at all.
    fraction = F.sum(F.when(F.col("total_b").isNotNull(), F.col("size"))) / F.least(F.max("total_a"), F.max("total_b"))
    fractions = (
        candidates.join(left, "class_a", "left").join(right, ["class_b", "digest"], "left")
        .groupBy("class_a", "class_b").agg(F.coalesce(fraction, F.lit(0.0)).alias("overlap"), F.max("near").alias("near"))
        .where(F.col("near") | (F.col("overlap") >= overlap)).select("class_a", "class_b", "overlap")
    )
    checked = python_map(_with_texts(fractions, live), _check, "class_a binary, class_b binary, overlap double")
    return cut(same.unionByName(checked)), members


def _matched(pairs: DataFrame, members: DataFrame, train: str) -> DataFrame:
    """Members of the classes of some pair, each once: those of train in a ``class_a``, the others in a ``class_b``."""
    wanted = pairs.select(F.col("class_a").alias("class_id"), F.lit(True).alias("in_train"))
    wanted = wanted.union(pairs.select("class_b", F.lit(False))).distinct()
    rows = members.withColumn("in_train", F.col("split") == train).join(wanted, ["class_id", "in_train"], "left_semi")
    return cut(rows.dropDuplicates(["class_id", "row_id", "split"]))


def found_pairs(rows: DataFrame, train: str = "train") -> DataFrame:
    """``(row_a, row_b)``, smaller ``row_id`` first: one record in train, the other in another split."""
    pairs, members = cross_split_overlap(rows, train)
    rows = _matched(pairs, members, train)
    a = rows.where("in_train").select(F.col("class_id").alias("class_a"), F.col("row_id").alias("in_train"))
    b = rows.where("not in_train").select(F.col("class_id").alias("class_b"), F.col("row_id").alias("outside"))
    return pairs.join(a, "class_a").join(b, "class_b").select(
        F.least("in_train", "outside").alias("row_a"), F.greatest("in_train", "outside").alias("row_b")
    ).distinct()


def overlap_classes(rows: DataFrame, train: str = "train") -> DataFrame:
    """``(row_id, split, source, class_id, copies, links, overlap)``: one row per record that overlaps across the splits.

    ``copies`` counts the records of its class on the other side, ``links`` the
    other classes there, and ``overlap`` is the best fraction.  Copies are not
    expanded into pairs.
    """
    pairs, members = cross_split_overlap(rows, train)
    rows = _matched(pairs, members, train)
    sizes = rows.groupBy("class_id").agg(F.count_if("in_train").alias("trained"), F.count_if(~F.col("in_train")).alias("held"))
    links = pairs.select(F.col("class_a").alias("class_id"), F.lit(True).alias("in_train"), F.col("class_b").alias("other"), "overlap").union(
        pairs.select("class_b", F.lit(False), F.col("class_a"), "overlap")
    )
    links = links.groupBy("class_id", "in_train").agg(F.count_if(F.col("other") != F.col("class_id")).alias("links"), F.max("overlap").alias("overlap"))
    links = links.join(sizes, "class_id").select(
        F.lower(F.hex("class_id")).alias("class"), "class_id", "in_train", F.when(F.col("in_train"), F.col("held")).otherwise(F.col("trained")).alias("copies"), "links", "overlap"
    )
    return rows.join(links, ["class_id", "in_train"]).select("row_id", "split", "source", F.col("class").alias("class_id"), "copies", "links", "overlap")


def overlap_report(records: DataFrame, rows: DataFrame, train: str = "train") -> DataFrame:
    """Per split and source: records, records with a same or near-same one in train, and their mean best overlap.

    A null source is a group of its own.
    """
    pairs, members = cross_split_overlap(rows, train)
    best = pairs.groupBy(F.col("class_b").alias("class_id")).agg(F.max("overlap").alias("overlap"))
    hit = _matched(pairs, members, train).where("not in_train").join(best, "class_id").groupBy("row_id", "split").agg(F.max("overlap").alias("overlap"))
    all_rows = records.where("row_id is not null and split is not null").select("row_id", "split", "source").dropDuplicates(["row_id"])
    return (
        all_rows.where(F.col("split") != train).join(hit, ["row_id", "split"], "left").groupBy("split", "source")
        .agg(
            F.count(F.lit(1)).alias("records"), F.count("overlap").alias("overlapping"),
            F.count_if(F.col("overlap") >= 1.0).alias("same"), F.round(F.avg("overlap"), 4).alias("mean_overlap"),
        )
    )

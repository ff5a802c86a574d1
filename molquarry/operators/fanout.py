"""Fan-out of molecules into question rows, with counter-based randomness.

Every draw is a hash of seed, purpose and row key, so rows do not depend on
partitioning or order.  Distributions are those asked for; a sequential random
generator's own sequence is not repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..runtime import cut, draw, uniform, width

COLUMNS = "split", "kind", "question", "smiles", "prop", "prop2", "name", "answer", "clarify_text"


def pick(items: list, seed: int, *keys: Column | str) -> Column:
    """A uniform choice from a list of texts."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (draw(seed, *keys) % len(items) + 1).cast("int"))


def phrase(templates: dict[str, tuple[str, ...]], prop: Column, slot: str, value: Column, seed: int, *keys: Column | str) -> Column:
    """One of a property's phrasings, uniformly chosen, with its slot filled."""
    lookup = F.create_map(*[x for p, t in templates.items() for x in (F.lit(p), F.array(*[F.lit(y) for y in t]))])
    options = lookup[prop]
    text = F.element_at(options, (draw(seed, *keys) % F.size(options) + 1).cast("int"))
    return F.replace(text, F.lit(slot), value)


def corrupted(smiles: Column, seed: int, *keys: Column | str) -> Column:
    """One uniformly chosen character replaced by one of the corrupting characters; may happen to stay readable."""
    at = (draw(seed, F.lit("at"), *keys) % F.length(smiles) + 1).cast("int")
    mark = F.substr(F.lit(C.CORRUPTION), (draw(seed, F.lit("mark"), *keys) % len(C.CORRUPTION) + 1).cast("int"), F.lit(1))
    return F.overlay(smiles, mark, at, F.lit(1))


def _rows(df: DataFrame, kind: str, **values: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    filled = {"split": F.col("split"), "kind": F.lit(kind)} | values
    return df.select(*[filled.get(c, null).cast("string").alias(c) for c in COLUMNS])


def single_rows(molecules: DataFrame, props: tuple[str, ...], seed: int, paraphrase: bool = True) -> DataFrame:
    """A row per molecule and property; ``molecules`` is ``(key, split, smiles)``."""
    fan = molecules.withColumn("prop", F.explode(F.array(*[F.lit(p) for p in props])))
    templates = C.TEMPLATES if paraphrase else {p: t[:1] for p, t in C.TEMPLATES.items()}
    question = phrase(templates, F.col("prop"), "{smiles}", F.col("smiles"), seed, F.lit("single"), "key", "prop")
    return _rows(fan, "single", question=question, smiles=F.col("smiles"), prop=F.col("prop"))


def corrupt_rows(molecules: DataFrame, seed: int, rate: float = C.CORRUPT_RATE_V1) -> DataFrame:
    """Validity questions about corrupted SMILES, for a share of the molecules."""
    some = molecules.where((uniform(seed, F.lit("corrupt?"), "key") < rate) & (F.length("smiles") > 0))
    bad = corrupted(F.col("smiles"), seed, "key")
    question = F.replace(F.lit(C.TEMPLATES["validity"][0]), F.lit("{smiles}"), bad)
    return _rows(some, "single", question=question, smiles=bad, prop=F.lit("validity"))


def error_rows(molecules: DataFrame, seed: int, rate: float = C.ERROR_RATE) -> DataFrame:
    """Property questions (not validity) about corrupted SMILES."""
    some = molecules.where((uniform(seed, F.lit("error?"), "key") < rate) & (F.length("smiles") > 0))
    good = [p for p in C.ALL_PROPERTIES if p != "validity"]
    some = some.withColumn("prop", pick(good, seed, F.lit("error prop"), "key")).withColumn("smiles", corrupted(F.col("smiles"), seed, "key"))
    question = phrase(C.TEMPLATES, F.col("prop"), "{smiles}", F.col("smiles"), seed, F.lit("error"), "key")
    return _rows(some, "error", question=question, smiles=F.col("smiles"), prop=F.col("prop"))


def multi_rows(molecules: DataFrame, seed: int, rate: float = C.MULTI_RATE, pairs: tuple = C.PROPERTY_PAIRS) -> DataFrame:
    """Questions for two properties of one molecule; ``prop`` and ``prop2``."""
    some = molecules.where(uniform(seed, F.lit("multi?"), "key") < rate)
    pair = F.split(pick([f"{a}|{b}" for a, b in pairs], seed, F.lit("pair"), "key"), r"\|")
    spoken = F.transform(pair, lambda p: F.replace(p, F.lit("_"), F.lit(" ")))
    question = F.concat(F.lit("For "), F.col("smiles"), F.lit(", give the "), spoken[0], F.lit(" and the "), spoken[1], F.lit("."))
    return _rows(some, "multi", question=question, smiles=F.col("smiles"), prop=pair[0], prop2=pair[1])


def _bank(items: tuple, *keys: Column | str, seed: int) -> Column:
    """A choice from the part of a bank that belongs to the row's split."""
    parts = {s: [x for i, x in enumerate(items) if i % 3 == k] for k, s in enumerate(("train", "val", "test"))}
    out = None
    for s, part in parts.items():
        choice = pick(part, seed, *keys)
        out = F.when(F.col("split") == s, choice) if out is None else out.when(F.col("split") == s, choice)
    return out


def clarify_rows(molecules: DataFrame, seed: int, rate: float = C.CLARIFY_RATE) -> DataFrame:
    """Questions that lack their molecule, from the split's part of the bank."""
    some = molecules.where(uniform(seed, F.lit("clarify?"), "key") < rate)
    question = _bank(C.CLARIFY_BANK, F.lit("clarify"), "key", seed=seed)
    return _rows(some, "clarify", question=question, clarify_text=F.lit(C.CLARIFY_TEXT))


def bank_rows(molecules: DataFrame) -> DataFrame:
    """The bank's questions in their splits, repeated ``max(1, min(5, molecules div 500))`` times."""
    spark = molecules.sparkSession
    bank = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate(C.BANK)], "pos int, question string, answer string")
    split = F.when(F.col("pos") % 3 == 0, "train").when(F.col("pos") % 3 == 1, "val").otherwise("test")
    sizes = molecules.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    reps = F.greatest(F.lit(1), F.least(F.lit(C.BANK_REPEAT_CAP), F.floor(F.coalesce("n", F.lit(0)) / 500))).cast("int")
    rows = bank.withColumn("split", split).join(F.broadcast(sizes), "split", "left")  # three rows
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), reps)))
    return _rows(rows, "no_tool", question=F.col("question"), answer=F.col("answer"))


def arithmetic_rows(molecules: DataFrame, seed: int) -> DataFrame:
    """A sum of two numbers from 1 to 50 per molecule."""
    a = draw(seed, F.lit("a"), "key") % 50 + 1
    b = draw(seed, F.lit("b"), "key") % 50 + 1
    rows = molecules.select("split", a.alias("a"), b.alias("b"))
    question = F.concat(F.lit("What is "), F.col("a"), F.lit(" plus "), F.col("b"), F.lit("?"))
    return _rows(rows, "no_tool", question=question, answer=(F.col("a") + F.col("b")).cast("string"))


def name_splits(names: DataFrame) -> DataFrame:
    """``(name, split)``: distinct names in binary order, their position from 0 modulo three.

    Names are cut into ranges of about equal size; a position is the place in
    the range and the number of names in earlier ranges, so no task sorts all
    names, however many share a prefix.
    """
    spark = names.sparkSession
    base = names.select("name").where("name is not null").distinct().repartitionByRange(width(spark), "name")
    # Written once: the ranges are drawn from a sample and must be the same for counts and rows.
    base = cut(base.withColumn("range", F.spark_partition_id()))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("name")) - 1
    k = (F.col("offset") + F.col("inside")) % 3
    split = F.when(k == 0, "train").when(k == 1, "val").otherwise("test")
    # One row a range: broadcast is bounded by the number of tasks.
    return base.withColumn("inside", inside).join(F.broadcast(offsets), "range").select("name", split.alias("split"))


def chain_rows(names: DataFrame, molecules: DataFrame, seed: int, target: float = 1.0) -> DataFrame:
    """Questions about named molecules; ``names`` is ``(name, split)``.

    Each name is repeated ``max(1, min(100, round(target x molecules / names)))``
    times in its split, rounding halves to even, each time with a property of
    its own.
    """
    n_mol = molecules.groupBy("split").agg(F.count(F.lit(1)).alias("n_mol"))
    n_name = names.groupBy("split").agg(F.count(F.lit(1)).alias("n_name"))
    ratio = F.floor(F.lit(target) * F.coalesce("n_mol", F.lit(0))) / F.greatest("n_name", F.lit(1))
    reps = F.greatest(F.lit(1), F.least(F.lit(C.CHAIN_REPEAT_CAP), F.bround(ratio, 0))).cast("int")
    sizes = n_name.join(n_mol, "split", "left").select("split", reps.alias("reps"))  # three rows
    rows = names.join(F.broadcast(sizes), "split").withColumn("rep", F.explode(F.sequence(F.lit(1), F.col("reps"))))
    good = [p for p in C.ALL_PROPERTIES if p != "validity"]
    rows = rows.withColumn("prop", pick(good, seed, F.lit("chain prop"), "name", "rep"))
    question = phrase(C.NAME_TEMPLATES, F.col("prop"), "{name}", F.col("name"), seed, F.lit("chain"), "name", "rep")
    return _rows(rows, "chain", question=question, prop=F.col("prop"), name=F.col("name"))


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in a seeded random order."""
    return rows.orderBy(draw(seed, F.lit("shuffle"), *keys), *keys)


def bench_rows(molecules: DataFrame, seed: int = 0) -> DataFrame:
    """The hard benchmark: nine paraphrases and five pairs per molecule, and five questions that need no tool.

    ``(kind, question, smiles, prop, prop2, expects_tool, answer)``.
    """
    spark = molecules.sparkSession
    para = molecules.withColumn("prop", F.explode(F.array(*[F.lit(p) for p in C.V1_PROPERTIES])))
    text = F.create_map(*[F.lit(x) for p in C.V1_PROPERTIES for x in (p, C.TEMPLATES[p][1])])
    para = para.select(F.lit("paraphrase").alias("kind"), F.replace(text[F.col("prop")], F.lit("{smiles}"), F.col("smiles")).alias("question"), "smiles", "prop", F.lit(True).alias("expects_tool"))
    pairs = F.array(*[F.struct(F.lit(a).alias("prop"), F.lit(b).alias("prop2")) for a, b in C.PROPERTY_PAIRS[:5]])
    multi = molecules.withColumn("p", F.explode(pairs)).select("smiles", "p.prop", "p.prop2")
    spoken = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    question = F.concat(F.lit("For "), F.col("smiles"), F.lit(", give the "), spoken("prop"), F.lit(" and the "), spoken("prop2"), F.lit("."))
    multi = multi.select(F.lit("multi").alias("kind"), question.alias("question"), "smiles", "prop", "prop2", F.lit(True).alias("expects_tool"))
    plain = spark.createDataFrame(list(C.BENCH_NO_TOOL), "question string, answer string")
    plain = plain.select(F.lit("no_tool").alias("kind"), "question", "answer", F.lit(False).alias("expects_tool"))
    columns = ["kind", "question", "smiles", "prop", "prop2", "expects_tool", "answer"]
    return para.unionByName(multi, allowMissingColumns=True).unionByName(plain, allowMissingColumns=True).select(*columns)

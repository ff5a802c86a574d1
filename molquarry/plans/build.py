"""Dataset builds: scan, accept, dedupe, split by scaffold, fan out, check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.features import with_features
from ..functions.text import plain_smiles
from ..operators import fanout as R
from ..operators import molecules as M
from ..operators import names as J
from ..runtime import cut
from ..sources.config import BuildConfig
from ..sources.readers import scan


def molecules(raw: DataFrame, limit: int = 0, drug_like: bool = False, seed: int = 0, position: str | None = None) -> DataFrame:
    """``(key, smiles, scaffold, split)`` of accepted molecules, canonical and distinct.

    With a ``position`` column the first by position win; without one the order
    is a hash of the molecule, the same on any partitioning.
    """
    rows = raw.select(plain_smiles("smiles").alias("smiles"), *([F.col(position).alias("at")] if position else [])).where("smiles is not null")
    rows = with_features(rows).where(M.accepted(drug_like=drug_like))
    rows = rows.select(F.col("features.canonical").alias("smiles"), F.col("features.scaffold").alias("scaffold"), F.col("at") if position else R.draw(seed, F.lit("order"), "features.canonical").alias("at"))
    # Written once: the kernel is behind it, and every fan-out reads it.
    rows = cut(M.first_wins(rows, "smiles", "at", limit))
    return M.group_split(rows.select(F.col("smiles").alias("key"), "smiles", "scaffold"), "scaffold", seed)


def rows_v1(mols: DataFrame, seed: int = 0) -> DataFrame:
    """First version: nine properties in one phrasing, corrupted validity questions."""
    return R.single_rows(mols, C.V1_PROPERTIES, seed, paraphrase=False).unionByName(R.corrupt_rows(mols, seed))


def rows_v2(mols: DataFrame, seed: int = 0) -> DataFrame:
    """Second version: fourteen properties with paraphrases, error, multi, clarify and no_tool rows."""
    out = R.single_rows(mols, C.ALL_PROPERTIES, seed)
    for part in (R.error_rows(mols, seed), R.multi_rows(mols, seed), R.clarify_rows(mols, seed), R.bank_rows(mols), R.arithmetic_rows(mols, seed)):
        out = out.unionByName(part)
    return out


def rows_v3(mols: DataFrame, dictionary: DataFrame, seed: int = 0) -> DataFrame:
    """Third version: the second and questions about named molecules."""
    return rows_v2(mols, seed).unionByName(R.chain_rows(R.name_splits(dictionary), mols, seed))


def build(spark: SparkSession, config: BuildConfig, dictionary: DataFrame | None = None) -> DataFrame:
    """Question rows of a configured build, shuffled."""
    raw = scan(spark, config.source, config.path, config.column)
    mols = molecules(raw, config.limit, config.drug_like, config.seed)
    if config.version == 1:
        rows = rows_v1(mols, config.seed)
    elif config.version == 2 or dictionary is None:
        rows = rows_v2(mols, config.seed)
    else:
        rows = rows_v3(mols, dictionary, config.seed)
    return R.shuffled(rows, config.seed, "split", "question")


def check(mols: DataFrame, rows: DataFrame, dictionary: DataFrame | None = None) -> dict[str, int]:
    """Leaks and gaps, all zero for a sound build: scaffolds and chain names in two splits, names without molecule."""
    leaks = {f"scaffold {r['split_a']}-{r['split_b']}": r["shared"] for r in M.split_overlaps(mols, "scaffold").collect()}
    names = rows.where("kind = 'chain'")
    leaks |= {f"name {r['split_a']}-{r['split_b']}": r["shared"] for r in M.split_overlaps(names, "name").collect()}
    if dictionary is not None:
        leaks["unresolved names"] = J.unresolved(names.select("name"), dictionary).count()
    return leaks


def assert_sound(mols: DataFrame, rows: DataFrame, dictionary: DataFrame | None = None) -> None:
    """Raise if ``check`` finds anything.

    The empty scaffold is one group and lies in one split like any other.
    """
    bad = {k: n for k, n in check(mols, rows, dictionary).items() if n}
    if bad:
        raise AssertionError(f"splits leak or names are missing: {bad}")

"""Molecule identity as a table function: each distinct spelling is parsed once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..chem import canonical_smiles
from ..runtime import python_map, width
from .text import plain_smiles, term


def _canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(molecule=[canonical_smiles(s) for s in pdf["spelling"]])


def counted_molecules(spellings: DataFrame) -> DataFrame:
    """``(spelling, n, molecule)`` for each distinct non-null ``spelling`` and its number of rows; unreadable ones are left out.

    ``molecule`` is the canonical SMILES, the same for all spellings of a
    molecule.  Spellings are expected in plain form (``plain_smiles``).
    """
    counts = spellings.where("spelling is not null").groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
    # By a hash of its own: a repartition by the same key and number as the aggregate before it is optimised away, and
    # the partitions that are left are merged by their few bytes, not by the Python time they take.
    spread = counts.repartition(width(spellings.sparkSession), F.xxhash64("spelling"))
    return python_map(spread, _canonical, "spelling string, n bigint, molecule string").where("molecule is not null")


def molecules_of(spellings: DataFrame) -> DataFrame:
    """``(spelling, molecule)`` for each distinct non-null ``spelling``; unreadable ones are left out."""
    return counted_molecules(spellings.select("spelling")).drop("n")


def name_spellings(name_dict: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """``(name_term, spelling, _from)`` of the dictionary (0) and the controls (1)."""
    rows = name_dict.select(term("name").alias("name_term"), plain_smiles("smiles").alias("spelling"), F.lit(0).alias("_from"))
    if controls is not None:
        rows = rows.unionByName(
            controls.select(term("name").alias("name_term"), plain_smiles("smiles").alias("spelling"), F.lit(1).alias("_from"))
        )
    return rows


def named_molecules(name_dict: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """``(name_term, molecule)`` of the dictionary and the controls; for a name in both the dictionary counts.

    A name whose SMILES cannot be read is left out.
    """
    rows = name_spellings(name_dict, controls)
    return (
        rows.join(molecules_of(rows), "spelling").where("name_term is not null")
        .groupBy("name_term").agg(F.min_by("molecule", F.struct("_from", "molecule")).alias("molecule"))
    )


def positions(*tables: DataFrame) -> DataFrame:
    """``(molecule, pos)`` with the smallest ``pos`` of each molecule over tables ``(pos, smiles)``."""
    rows = None
    for t in tables:
        part = t.select("pos", plain_smiles("smiles").alias("spelling"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(molecules_of(rows), "spelling").groupBy("molecule").agg(F.min("pos").alias("pos"))

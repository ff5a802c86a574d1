"""Name resolution against a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.protocol import strip


def name_key(c: Column) -> Column:
    """The key of a name: stripped and lower-cased."""
    return F.lower(strip(c))


def resolve(df: DataFrame, dictionary: DataFrame, name: str = "name", out: str = "resolved") -> DataFrame:
    """Left look-up: add the SMILES of each name, null for misses and null names.

    Spark broadcasts the dictionary if its size is below the broadcast
    threshold and sorts both sides otherwise.
    """
    table = dictionary.select(F.col("name").alias("_key"), F.col("smiles").alias(out))
    return df.join(table, name_key(F.col(name)) == F.col("_key"), "left").drop("_key")


def unresolved(df: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """Rows with a name that the dictionary lacks; empty if the dictionary is total."""
    keys = dictionary.select(F.col("name").alias("_key"))
    return df.where(F.col(name).isNotNull()).join(keys, name_key(F.col(name)) == F.col("_key"), "left_anti")


def one_per_name(df: DataFrame) -> DataFrame:
    """A dictionary with repeated names collapsed to the first SMILES in binary order."""
    return df.where("name is not null").groupBy("name").agg(F.min("smiles").alias("smiles"))

"""The property kernel as a table function: each distinct spelling is computed once, then joined back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..chem.props import properties
from ..runtime import python_map, width

FIELDS = {
    "validity": "boolean", "mw": "double", "logp": "double", "tpsa": "double", "hbd": "int", "hba": "int", "ring_count": "int",
    "lipinski": "boolean", "canonical": "string", "qed": "double", "formula": "string", "num_stereocenters": "int",
    "veber": "boolean", "pains_alert": "boolean", "heavy_atoms": "int", "scaffold": "string",
}
_PANDAS = {"boolean": "boolean", "double": "Float64", "int": "Int32", "string": "object"}
SCHEMA = "spelling string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def _compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [properties(s) for s in pdf["spelling"]]
        out = pd.DataFrame({"spelling": pdf["spelling"].to_numpy()})
        for k, kind in FIELDS.items():
            out[k] = pd.array([r.get(k) for r in rows], dtype=_PANDAS[kind])
        yield out


def features_of(spellings: DataFrame) -> DataFrame:
    """All properties of each distinct non-null ``spelling``; unreadable ones have ``validity`` false and nulls."""
    distinct = spellings.select("spelling").where("spelling is not null").distinct()
    return python_map(distinct.repartition(width(spellings.sparkSession), F.xxhash64("spelling")), _compute, SCHEMA)


def with_features(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Rows with a struct ``features`` of their SMILES (null where the SMILES is null)."""
    table = features_of(df.select(F.col(smiles).alias("spelling")))
    packed = table.select(F.col("spelling").alias("_spelling"), F.struct(*FIELDS).alias("features"))
    return df.join(packed, F.col(smiles) == F.col("_spelling"), "left").drop("_spelling")


def python_float(c: Column) -> Column:
    """A double as Python's ``str`` prints it: shortest digits, exponent from 1e16 and below 1e-4."""
    text = c.cast("string")
    mantissa = F.regexp_extract(text, r"^(-?)(\d)\.?(\d*)E(-?\d+)$", 2)
    tail = F.regexp_extract(text, r"^(-?)(\d)\.?(\d*)E(-?\d+)$", 3)
    sign = F.regexp_extract(text, r"^(-?)(\d)\.?(\d*)E(-?\d+)$", 1)
    power = F.try_to_number(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("S999")).cast("int")
    digits = F.when(tail == "0", mantissa).otherwise(F.concat(mantissa, tail))
    size = F.length(digits)
    whole = F.concat(sign, F.rpad(digits, F.greatest(power + 1, size), "0"))
    fixed = F.when(size > power + 1, F.concat(sign, F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))).otherwise(
        F.concat(whole, F.lit(".0"))
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    short = F.concat(sign, mantissa, F.when((tail == "0") | (tail == ""), "").otherwise(F.concat(F.lit("."), tail)))
    expo = F.concat(short, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when(text.isin("NaN"), "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf")
        .when(~text.contains("E"), text)
        .when((power >= 0) & (power < 16), fixed).when((power < 0) & (power >= -4), small).otherwise(expo)
    )


def rendered(features: str = "features") -> Column:
    """``map<prop, text>`` of a feature struct, each value as Python's ``str`` prints it; missing values are left out."""
    pairs = []
    for k, kind in FIELDS.items():
        if k in ("heavy_atoms", "scaffold"):
            continue
        c = F.col(f"{features}.{k}")
        text = python_float(c) if kind == "double" else F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string")
        pairs.append(F.struct(F.lit(k).alias("key"), text.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))

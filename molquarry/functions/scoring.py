"""Tolerance-aware scoring of answers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import FALSE_WORDS, TRUE_WORDS
from .protocol import strip, tokens

# Texts that Python's float() and int() accept (ASCII).
_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_INT = r"^[+-]?\d+(_\d+)*$"


def as_float(text: Column) -> Column:
    """The number a text spells, or null; infinities and NaN as Python reads them."""
    t = strip(text)
    word = F.regexp_replace(F.lower(t), r"^[+-]", "")
    return (
        F.when(t.rlike(_FLOAT), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
        .when(word.isin("inf", "infinity"), F.when(t.startswith("-"), float("-inf")).otherwise(float("inf")))
        .when(word == "nan", float("nan"))
    )


def as_int(text: Column) -> Column:
    """The whole number a text spells, or null; ``1.0`` spells none."""
    t = strip(text)
    return F.when(t.rlike(_INT), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint"))


def as_bool(text: Column) -> Column:
    """The truth value a text spells, or null."""
    t = F.lower(strip(text))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def score(vtype: Column, tol: Column, predicted: Column, truth: Column, predicted_canonical: Column | None = None) -> Column:
    """Whether a text is the truth (a text too, as Python prints it) for a property of this type; never null.

    ``str`` truths are canonical SMILES and compare with
    ``predicted_canonical``, the canonical form of the prediction if that can
    be read; without it, with the text itself.
    """
    a, b = as_float(predicted), as_float(truth)
    near = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) <= tol)
    same = predicted_canonical if predicted_canonical is not None else strip(predicted)
    right = (
        F.when(vtype == "float", near)
        .when(vtype == "int", as_int(predicted) == as_int(truth))
        .when(vtype == "bool", as_bool(predicted) == as_bool(truth))
        .when(vtype == "str", same == truth)
        .when(vtype == "str_exact", F.upper(strip(predicted)) == F.upper(strip(truth)))
    )
    return F.coalesce(right & truth.isNotNull(), F.lit(False))


def final_covers(vtype: Column, tol: Column, final: Column, truth: Column, canonical: Column | None = None) -> Column:
    """Whether an answer, or one of its words, scores.

    ``canonical`` maps words and whole answers to canonical SMILES, for ``str``
    properties.
    """
    words = F.concat(F.array(final), tokens(final))
    return F.coalesce(
        F.exists(words, lambda t: score(vtype, tol, t, truth, canonical[strip(t)] if canonical is not None else None)), F.lit(False)
    )

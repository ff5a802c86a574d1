"""What the operators on question records share: which molecules a record refers to, and its terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK, fold, plain_smiles, term


def pair_refs() -> Column:
    """``pairs`` as plain spellings and prop terms; null where ``pairs`` is null."""
    return F.transform("pairs", lambda p: F.struct(plain_smiles(p["smiles"]).alias("spelling"), term(p["prop"]).alias("prop_term")))


def question_spellings(question: Column | str = "question") -> Column:
    """Words of a question that may be a SMILES; the kernel says which can be read.

    Sentence marks and quotes around a word do not belong to it.  Any word of
    the SMILES alphabet counts that holds a digit, a bond sign or a bracket, of
    any length (``CC=O``); one of letters alone counts with two carbons or more
    (``CCO``), which keeps out ordinary words that happen to be readable ("I",
    "NO", "COIN").  A single atom in brackets is no molecule here, as option
    marks (``[C]``) look alike.
    """
    words = F.split(fold(question), BLANK + "+")
    words = F.transform(words, lambda w: F.regexp_replace(w, "^[\"'<`,;]+|[\"'>`?!.,:;]+$", ""))
    return F.filter(
        words,
        lambda w: w.rlike(r"^[A-Za-z0-9@+\-\[\]()=#$%:/\\.*]+$") & w.rlike("[A-Za-z]")
        & (w.rlike(r"[()=#\[\]0-9]") & ~w.rlike(r"^\[[^\[\]]*\]$") | w.rlike("C.*C(?![a-z&&[^l]])")),
    )


def once(records: DataFrame, *columns: str) -> DataFrame:
    """Deliveries of one record (``row_id``) as one row; rows without ``row_id`` are no records."""
    return records.select("row_id", *columns).where("row_id is not null").dropDuplicates(["row_id"])

"""Text normalisation as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms of the printable ASCII characters lie at a fixed distance.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
BLANK = r"[\s\p{Z}\x85]"
_INVISIBLE = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{034F}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Full-width characters as plain ones, invisible characters removed."""
    return F.regexp_replace(F.translate(_col(c), _WIDE, _PLAIN), _INVISIBLE, "")


# Spellings that need no normalising, which most are, are told by one cheap pattern.
_CLEAN_TERM = r"^[a-z0-9]++(?:[ _-][a-z0-9]++)*+\z"
_CLEAN_SMILES = r"^[!#-&(-;=?-_a-~]++\z"


def term(c: Column | str) -> Column:
    """The term a spelling stands for: lower case, plain width, single blanks for blanks, ``-`` and ``_``.

    Null stays null; a spelling with nothing visible in it is null too.
    """
    t = F.trim(F.regexp_replace(F.lower(fold(c)), r"[\s\p{Z}\x85_\-]+", " "))
    return F.when(_col(c).rlike(_CLEAN_TERM), F.translate(_col(c), "_-", "  ")).otherwise(F.nullif(t, F.lit("")))


def plain_smiles(c: Column | str) -> Column:
    """A SMILES without blanks, invisible characters, character width and enclosing quotes or angle brackets."""
    t = F.regexp_replace(fold(c), BLANK, "")
    t = F.regexp_replace(t, "^[\"'<`]+|[\"'>`]+$", "")
    return F.when(_col(c).rlike(_CLEAN_SMILES), _col(c)).otherwise(F.nullif(t, F.lit("")))


def no_blanks(c: Column | str) -> Column:
    """Text without blanks of any kind."""
    return F.regexp_replace(_col(c), BLANK, "")

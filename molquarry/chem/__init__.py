"""Pure-Python molecule kernel (no Spark import)."""

from .canon import canonical_smiles, write_smiles
from .parse import Molecule, parse_smiles

__all__ = ["Molecule", "canonical_smiles", "parse_smiles", "write_smiles"]

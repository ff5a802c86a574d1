"""Presets and settings of a dataset build."""

from __future__ import annotations

from dataclasses import dataclass

# Molecules of the presets.
PRESETS = {"dev": 200, "full": 10000}


@dataclass(frozen=True)
class BuildConfig:
    """Settings of a build; ``n_molecules`` 0 takes the preset's number, an unknown name that of ``dev``."""

    name: str = "dev"
    source: str = "parquet"
    path: str = ""
    column: str = "smiles"
    n_molecules: int = 0
    drug_like: bool = False
    seed: int = 0
    version: int = 3

    @property
    def limit(self) -> int:
        return self.n_molecules or PRESETS.get(self.name, PRESETS["dev"])

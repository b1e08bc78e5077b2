"""Recipe parameters as columns.

Operators take a mapping ``name -> Column``. The values may be literals (one
recipe for everything) or columns that a profile join put on each row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewatch.fixed import RECIPE_DEFAULTS

Recipe = Mapping[str, Column]


def recipe(**overrides) -> dict[str, Column]:
    """The default recipe as literals; an override may be a value or a Column."""
    unknown = set(overrides) - set(RECIPE_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown recipe fields: {sorted(unknown)}")
    merged = {**RECIPE_DEFAULTS, **overrides}
    return {k: v if isinstance(v, Column) else F.lit(v) for k, v in merged.items()}


def recipe_from(df, **overrides) -> dict[str, Column]:
    """Use the recipe columns that ``df`` carries and defaults for the others."""
    carried = {k: F.col(k) for k in RECIPE_DEFAULTS if k in df.columns}
    return recipe(**{**carried, **overrides})

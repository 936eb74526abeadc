"""How parsing work is laid out over tasks and plan nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_once(table: DataFrame, *columns: str) -> DataFrame:
    """Keep filters above from copying the expressions of ``columns`` into themselves.

    The optimizer moves a filter below a projection by substituting what the projection computes, so parsing
    would run twice. It does not move filters on generated columns below the generator.
    """
    fields = F.struct(*columns)
    return table.select(*[c for c in table.columns if c not in columns], F.inline(F.array(fields)))

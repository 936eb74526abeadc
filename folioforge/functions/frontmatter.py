"""YAML front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes inside a double-quoted YAML scalar; the backslash comes first.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0"))


def yaml_escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def front_matter(fields: dict[str, Column]) -> Column:
    """A block with one quoted line per field, in the given order; null fields are left out."""
    lines = [F.concat(F.lit(f'{name}: "'), yaml_escape(value), F.lit('"')) for name, value in fields.items()]
    # concat is null as soon as one part is, and concat_ws skips nulls.
    return F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---")), F.lit("\n"))

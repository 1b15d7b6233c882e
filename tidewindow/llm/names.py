"""Names for helper columns beside a caller's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores in front as keep it apart from the columns of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = "__" + name
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out

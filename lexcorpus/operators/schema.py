"""Column checks that fail before any job starts, and names that clash with none."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing column(s): {', '.join(missing)}")
    return df


def free_names(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, with underscores in front where one of ``columns`` has that name (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out

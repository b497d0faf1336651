"""ORDER BY terms, LIMIT and OFFSET with the dialect's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import semantics as S


def term(x: Column, descending: bool = False, nulls: str | None = None, collation: str = "binary") -> Column:
    """One ORDER BY term: NULLs come first ascending and last descending unless said otherwise."""
    x = {"binary": lambda c: c, "nocase": S.nocase, "rtrim": S.rtrimmed}[collation](x)
    first = (nulls or ("last" if descending else "first")) == "first"
    if descending:
        return x.desc_nulls_first() if first else x.desc_nulls_last()
    return x.asc_nulls_first() if first else x.asc_nulls_last()


def by_position(df: DataFrame, *positions: int) -> DataFrame:
    """ORDER BY 2, -1: result columns by number from 1; negative numbers descend."""
    return df.orderBy(*(term(F.col(df.columns[abs(p) - 1]), p < 0) for p in positions))


def limit(df: DataFrame, count: int | None, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET: a negative count takes all rows, a negative offset skips none."""
    df = df.offset(offset) if offset > 0 else df
    return df if count is None or count < 0 else df.limit(count)

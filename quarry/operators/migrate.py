"""Incremental loads with validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the source with a key above the target's highest. The bound is read first, so that it reaches the source's scan."""
    top = target.agg(F.max(key)).first()[0]
    return source if top is None else source.where(F.col(key) > top)


def loaded(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """The target after the load."""
    return target.unionByName(new_rows(source, target, key))


def mismatches(source: DataFrame, target: DataFrame, key: str, exact: list[str], near: list[str], tolerance: float = 1e-4) -> DataFrame:
    """problem, n: rows missing on either side, and rows whose fields differ (numbers: by more than the tolerance)."""
    s, t = source.alias("s"), target.alias("t")
    both = s.join(t, F.col(f"s.{key}") == F.col(f"t.{key}"), "full_outer")
    differs = F.lit(False)
    for c in exact:
        differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    for c in near:
        differs = differs | F.coalesce(F.abs(F.col(f"s.{c}") - F.col(f"t.{c}")) > tolerance, F.col(f"s.{c}").isNull() != F.col(f"t.{c}").isNull())
    problem = F.when(F.col(f"t.{key}").isNull(), "missing").when(F.col(f"s.{key}").isNull(), "extra").when(differs, "different").otherwise("same")
    return both.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


def half(column: str):
    """A float array rounded to half precision and back, in Arrow batches."""
    @F.pandas_udf("array<float>")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return rounded(column)


def floats(column: str, dimension: int):
    """Little-endian 4-byte floats of a binary column; trailing bytes and numbers beyond the dimension go."""
    @F.pandas_udf("array<float>")
    def parsed(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4")[:dimension])

    return parsed(column)

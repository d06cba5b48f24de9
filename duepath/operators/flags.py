"""Missing-value flags, imputation and scaling of a feature matrix."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duepath.operators import features as ft
from duepath.operators.ordered import group_stats
from duepath.operators.reports import unpivot

FLAGS = ("income_detected", "thin_file", "declared_provided", "n_features_missing")
FLAG_DIRECTION = {"income_detected": -1, "thin_file": 1, "declared_provided": 0, "n_features_missing": 1}


def add_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    c = F.col
    missing = sum((c(x).isNull().cast("double") for x in columns if x not in FLAGS), F.lit(0.0))
    return df.withColumns({
        "income_detected": F.coalesce(c("monthly_income") > 0, F.lit(False)).cast("double"),
        "thin_file": F.coalesce(c("num_active_obligations") <= 0, F.lit(True)).cast("double"),
        "declared_provided": (c("declared_income_gap").isNotNull() | c("declared_is_homeowner").isNotNull()).cast("double"),
        "n_features_missing": missing,
    })


def coverage(df: DataFrame, columns: Sequence[str] = FLAGS) -> DataFrame:
    """Mean of each flag, and whether it is constant and so carries nothing."""
    stats = df.agg(F.array(*[
        F.struct(F.lit(x).alias("flag"), F.avg(x).alias("coverage"), (F.min(x) == F.max(x)).alias("constant")) for x in columns
    ]).alias("s"))
    return stats.select(F.inline("s"))


def medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of all columns in one job."""
    columns = list(columns)
    long = unpivot(train, [], columns)
    found = {r["feature"]: r["m"] for r in group_stats(long, ["feature"], {}, {"m": "value"}).collect()}
    return {c: found.get(c) for c in columns}


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.fillna({c: 0.0 if v is None else float(v) for c, v in values.items()})


def spreads(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float | None]]:
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def varies(sd: float | None) -> bool:
    return bool(sd) and sd >= 1e-9


def moments(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    return {c: (m, sd if varies(sd) else 1.0) for c, (m, sd) in spreads(train, columns).items()}


def standardise(df: DataFrame, stats: dict[str, tuple[float, float]], columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in columns})


def allowed(names: Sequence[str], drop: Sequence[str] = (), parity_only: bool = True) -> list[str]:
    """Features left after the parity rule and the policy list."""
    keep = set(ft.PARITY_NAMES) if parity_only else set(ft.NAMES)
    return [n for n in names if n in keep and n not in set(drop)]


def labelled(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled numeric rows only."""
    numeric = [f.name for f in matrix.schema.fields if isinstance(f.dataType, T.NumericType)]
    return matrix.select("case_id", *numeric).join(labels.filter(F.col("target").isNotNull()), "case_id")


def spec_table(spark) -> DataFrame:
    rows = [(s.name, s.family, s.direction, s.parity, s.default) for s in ft.SPECS]
    return spark.createDataFrame(rows, "name string, family string, direction int, parity boolean, default_value double")

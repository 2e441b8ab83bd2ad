"""Full comparison of two tables that should differ only in their text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_exact(source: DataFrame, result: DataFrame, index: str, text_columns: list[str], id_column: str | None = None, allow_extra: bool = False) -> DataFrame:
    """code, n: how often each issue occurs, by row position (index). No row means that the result is valid.

    missing_column, extra_column, column_order, row_missing, row_extra,
    id_changed, metadata_changed. text_changed counts rows whose text differs, which is allowed.
    """
    spark = source.sparkSession
    lost, more = [c for c in source.columns if c not in result.columns], [c for c in result.columns if c not in source.columns]
    issues = [("missing_column", len(lost)), ("extra_column", 0 if allow_extra else len(more))]
    issues.append(("column_order", int([c for c in result.columns if c in source.columns] != [c for c in source.columns if c in result.columns])))
    both = [c for c in source.columns if c in result.columns and c != index]
    meta = [c for c in both if c not in text_columns and c != id_column]
    j = source.alias("s").join(result.alias("r"), F.col(f"s.{index}").eqNullSafe(F.col(f"r.{index}")), "full_outer")
    pair = F.col(f"s.{index}").isNotNull() & F.col(f"r.{index}").isNotNull()
    differ = lambda cols: pair & ~F.array_min(F.array(F.lit(True), *(F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols)))
    tests = {"row_missing": F.col(f"r.{index}").isNull(), "row_extra": F.col(f"s.{index}").isNull(), "metadata_changed": differ(meta), "text_changed": differ([c for c in text_columns if c in both])}
    if id_column:
        tests["id_changed"] = differ([id_column])
    counted = j.agg(*(F.coalesce(F.sum(F.when(t, 1).otherwise(0)), F.lit(0)).cast("long").alias(k) for k, t in tests.items()))
    rows = counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("code"), F.col(k).alias("n")) for k in tests))).alias("x")).select("x.*")
    return rows.unionByName(spark.createDataFrame(issues, "code string, n long")).where("n > 0")

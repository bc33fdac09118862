"""Data-quality checks: each is one pass over what it reads, a profile one for each column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.relational import except_all_counts, full_diff, row_counts

__all__ = ["check_fk", "check_rules", "check_unique", "describe_schema", "diff_by_key", "diff_multiset", "flag_days", "null_rate", "profile", "reject_report", "row_counts", "violations"]


def null_rate(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(F.col(column).isNull().cast("double")).alias("null_rate"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, n_present, n_distinct of each column. Each is a pass that reads its column alone and counts its values map-side, so no row is copied for another column."""
    one = lambda c: df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_present"), F.count("_v").alias("n_distinct"))
    return reduce(DataFrame.unionByName, [one(c).select(F.lit(c).alias("column_name"), "n_rows", "n_present", "n_distinct") for c in columns])


def violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or unknown."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


diff_by_key = full_diff
diff_multiset = except_all_counts


def check_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, n_failed of each SQL condition; an unknown result fails."""
    counted = df.agg(*[F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(f"r{i}") for i, e in enumerate(rules.values())])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n_failed")) for i, n in enumerate(rules)])))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_fk(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows with a key that the parent lacks; null keys refer to nothing and pass."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def reject_report(rejected: dict[str, DataFrame]) -> DataFrame:
    return row_counts(rejected)


def describe_schema(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def flag_days(df: DataFrame, ratio: str, threshold: float) -> DataFrame:
    return df.filter(F.col(ratio) > threshold)


def all_pass(report: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [F.every(F.col("n_failed") == 0)])

"""Tables of a folder as Spark DataFrames or private frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.frame import PrivateFrame
from ..policy import resolve_policy


def load(spark: SparkSession, folder: str, name: str, form: str = "parquet", **options) -> DataFrame:
    """``folder/name.form``; any batch format that Spark reads."""
    return spark.read.format(form).options(**options).load(f"{folder}/{name}.{form}")


def sources(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: load(spark, folder, n) for n in names}


def bind(spark: SparkSession, folder: str, name: str, suppression: str = "light", key: list[str] | None = None) -> PrivateFrame:
    return PrivateFrame.bind(load(spark, folder, name), resolve_policy(suppression=suppression), key)

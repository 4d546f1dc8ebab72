"""Reading observations and bringing them into the canonical array form."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldscope.session import cut_lineage

# Identifier and metadata columns that are never features.
REGRESSION_EXCLUDED = (
    "END_TIME", "END_TM", "FAB", "LOT_CD", "ALIAS_LOT_ID", "LOT_ID", "WF_ID",
    "group_key", "module", "recipe_id", "oper", "FAB(FDC)", "LOT_CD(FDC)",
)
CLUSTERING_EXCLUDED = ("END_TIME", "GROUP_ID")


def col(name: str) -> Column:
    """Column by exact name; feature names contain dots."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Observations:
    """Rows ``(row_id, ts, group_id, y, features)`` and the feature names.

    ``features`` is one ``array<double>`` in the order of ``names``, so plans
    stay small with tens of thousands of parameters.
    """

    df: DataFrame
    names: tuple[str, ...]

    def with_df(self, df: DataFrame) -> Observations:
        return replace(self, df=df)

    def long(self, *carry: str) -> DataFrame:
        """``(row_id, *carry, idx, value)``: one row per observation and feature."""
        return self.df.select("row_id", *carry, F.posexplode("features").alias("idx", "value"))

    def dictionary(self) -> DataFrame:
        """``(idx, feature)``, one row per feature."""
        rows = list(enumerate(self.names))
        return self.df.sparkSession.createDataFrame(rows, "idx int, feature string")

    def select(self, names: Sequence[str]) -> Observations:
        """Keep the named features, in the given order."""
        place = {n: i for i, n in enumerate(self.names)}
        wanted = F.expr("array(" + ",".join(str(place[n]) for n in names) + ")")
        picked = F.transform(wanted, lambda i: F.get("features", i))
        return Observations(self.df.withColumn("features", picked), tuple(names))


def input_path(base: str, job: str, fallback: str | None = None,
               spark: SparkSession | None = None) -> str:
    """``base/job``; if that does not exist and a fallback base is given, ``fallback/job``.

    Both bases are URIs of any file system Hadoop knows.
    """
    first = f"{base.rstrip('/')}/{job}"
    if fallback is None:
        return first
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(first)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return first if found else f"{fallback.rstrip('/')}/{job}"


def load_observations(spark: SparkSession, path: str,
                      schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, or Parquet. With a schema the CSV is not read twice."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def load_matrix(spark: SparkSession, path: str,
                schema: T.StructType | str | None = None) -> DataFrame:
    """CSV without a header: ``_c0`` is the id, ``_c1 …`` are features."""
    reader = spark.read.option("header", False)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def preview(df: DataFrame, rows: int = 5) -> dict:
    """Schema text, first rows, number of rows and of columns."""
    return {
        "schema": df.schema.simpleString(),
        "head": df.limit(rows).toPandas(),
        "rows": df.count(),
        "columns": len(df.columns),
    }


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in order, without the excluded names (exact comparison)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def as_double(name: str) -> Column:
    """Double value with NaN read as null."""
    value = col(name).cast("double")
    return F.when(~F.isnan(value), value)


def from_wide(df: DataFrame, response: str, row_id: str | None = None,
              time_col: str | None = "END_TIME", group_col: str | None = "GROUP_ID",
              exclude: Iterable[str] = REGRESSION_EXCLUDED) -> Observations:
    """Canonical observations from a wide table.

    Features are the numeric columns other than the response, the key, the time,
    the group and ``exclude``. Without a key column the rows are numbered once
    and written to the shared folder, so that a recomputed partition cannot
    number them anew. Keys must be unique; textual ones are hashed to 64 bits.
    """
    special = {response, time_col, group_col, *([row_id] if row_id else [])}
    names = numeric_columns(df, set(exclude) | special)
    if row_id is None:
        df = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
        row_id = "__row"
    have = set(df.columns)
    key = F.xxhash64(col(row_id)) if isinstance(df.schema[row_id].dataType, T.StringType) else col(row_id)
    textual = isinstance(df.schema[response].dataType, T.StringType)
    # a textual response is a class label: it stays text until it is label-encoded
    return Observations(
        df.select(
            key.cast("bigint").alias("row_id"),
            (col(time_col).cast("timestamp") if time_col in have
             else F.lit(None).cast("timestamp")).alias("ts"),
            (col(group_col).cast("string") if group_col in have
             else F.lit(None).cast("string")).alias("group_id"),
            (col(response) if textual else as_double(response)).alias("y"),
            F.array(*[as_double(n) for n in names]).alias("features") if names
            else F.array().cast("array<double>").alias("features"),
        ),
        tuple(names),
    )

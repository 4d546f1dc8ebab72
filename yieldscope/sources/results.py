"""Result tables: creation, partitions, writes and the customary reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldscope.functions.scalars import param_part, partition_value, report_round, step_part

# Columns of the result tables; every table is partitioned by dt.
COLUMNS = {
    "importance": "result STRING, xparam STRING, step_id STRING, importance_value DOUBLE, "
                  "jobid STRING",
    "coefficients": "result STRING, variable STRING, score DOUBLE, abs_score DOUBLE, jobid STRING",
    "final_report": "result STRING, final STRING, suggestion STRING, "
                    "abs_corr_final_suggestion DOUBLE, abs_corr_target_suggestion DOUBLE, "
                    "mean_of_corr DOUBLE, maximum_info_coeff DOUBLE, mean_of_corr_mic DOUBLE, "
                    "jobid STRING",
    "forest": "job_id STRING, param STRING, value DOUBLE",
}
SCORE = {"importance": "importance_value", "coefficients": "abs_score",
         "final_report": "mean_of_corr_mic", "forest": "value"}
JOB = {"importance": "jobid", "coefficients": "jobid", "final_report": "jobid",
       "forest": "job_id"}


def create_tables(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create the database and its four tables, partitioned by ``dt``."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")
    for name, columns in COLUMNS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}, dt STRING) "
                  "USING parquet PARTITIONED BY (dt)")


def add_partition(spark: SparkSession, table: str, dt: str) -> None:
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (dt='{dt}')")


def repair_partitions(spark: SparkSession, table: str) -> None:
    """Register partitions whose files other jobs wrote."""
    spark.sql(f"MSCK REPAIR TABLE {table}")


def list_partitions(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {table}")


def importance_rows(stats: DataFrame, code: str, job_id: str) -> DataFrame:
    """Rows of the importance table from ``(feature, mean)``."""
    return stats.select(
        F.lit(code).alias("result"), param_part(F.col("feature")).alias("xparam"),
        step_part(F.col("feature")).alias("step_id"), F.col("mean").alias("importance_value"),
        F.lit(job_id).alias("jobid"), partition_value(F.lit(job_id)).alias("dt"))


def coefficient_rows(coefs: DataFrame, code: str, job_id: str) -> DataFrame:
    """Rows of the coefficient table from ``(feature, score, abs_score)``."""
    return coefs.select(
        F.lit(code).alias("result"), F.col("feature").alias("variable"), "score", "abs_score",
        F.lit(job_id).alias("jobid"), partition_value(F.lit(job_id)).alias("dt"))


def final_rows(report: DataFrame, code: str, job_id: str) -> DataFrame:
    """Rows of the final table from a driver report; columns are matched by name."""
    return report.select(
        F.lit(code).alias("result"), "final", "suggestion", "abs_corr_final_suggestion",
        "abs_corr_target_suggestion", "mean_of_corr", "maximum_info_coeff", "mean_of_corr_mic",
        F.lit(job_id).alias("jobid"), partition_value(F.lit(job_id)).alias("dt"))


def forest_rows(importances: DataFrame, job_id: str) -> DataFrame:
    """Rows of the forest table from ``(param, value)``."""
    return importances.select(F.lit(job_id).alias("job_id"), "param", "value",
                              partition_value(F.lit(job_id)).alias("dt"))


def status_row(spark: SparkSession, code: str, job_id: str) -> DataFrame:
    """The one row that reports a rejected input in the importance table."""
    return spark.range(1).select(
        F.lit(code).alias("result"), F.lit("error").alias("xparam"), F.lit("error").alias("step_id"),
        F.lit(None).cast("double").alias("importance_value"), F.lit(job_id).alias("jobid"),
        partition_value(F.lit(job_id)).alias("dt"))


def append(rows: DataFrame, table: str) -> None:
    """Append to the table's ``dt`` partitions; columns are matched by name."""
    rows.write.mode("append").format("parquet").partitionBy("dt").saveAsTable(table)


def read_results(spark: SparkSession, database: str, kind: str, job_id: str | None = None,
                 dt: str | None = None, limit: int | None = None, digits: int = 4) -> DataFrame:
    """Rows of one job or one ``dt``, highest score first, numbers rounded.

    The partition is derived from the job, so only its files are read.
    """
    out = spark.table(f"{database}.{kind}")
    if job_id is not None:
        out = out.filter((F.col(JOB[kind]) == job_id) & (F.col("dt") == job_id[:8]))
    if dt is not None:
        out = out.filter(F.col("dt") == dt)
    keys = [c for c, t in out.dtypes if t == "string"]
    out = out.orderBy(F.desc_nulls_last(SCORE[kind]), *keys)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*[report_round(F.col(c), digits).alias(c) if t == "double" else c
                        for c, t in out.dtypes])


def write_single_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with header, replacing the path; ``single=False`` keeps one file per task."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)

"""File sources and sinks: all-string CSV, JSON Lines, Parquet with a fixed schema, build manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a filing manifest.
MANIFEST = "id filename product_line indemnity_regime insurer cnpj susep_process process_year susep_ramo susep_subramo susep_version version_start_date page_count retrieved_at source_url selection_rationale extraction_mode".split()


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column a string: numbers of companies and years keep their zeros."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines against a fixed schema; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_parquet(rows: DataFrame, path: str, *partition_by: str) -> None:
    writer = rows.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def build_manifest(rows: DataFrame, document: str) -> DataFrame:
    """(document, rows): rows of each document, and of all under a null document."""
    return rows.rollup(document).agg(F.count("*").alias("rows"))


def checked(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations): for each named SQL predicate how many rows don't satisfy it; null counts as a violation."""
    counts = rows.agg(*[F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(n) for n, p in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")

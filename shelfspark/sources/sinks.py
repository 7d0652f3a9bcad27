"""Files that a run leaves: tables as CSV and JSON, the raw audit, the failure log, the report, the done keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.dataset import with_extras
from shelfspark.schema import UNIVERSAL_COLUMNS

# Fields that hold JSON text, the raw audit's columns, and the lines of the report.
JSON_FIELDS = ("variants", "specifications", "options", "images", "attributes", "reviews", "metadata")
RAW_COLUMNS = ("id", "handle", "title", "vendor", "product_type")
REPORT_LINES = (
    ("Total records", "total"), ("Missing title", "missing_title"), ("Missing price", "missing_price"), ("Missing description", "missing_description"),
    ("Missing image", "missing_image"), ("Missing category", "missing_category"), ("Missing SKU", "missing_sku"), ("With variants", "has_variants"),
)


def export_frame(df: DataFrame, columns: Sequence[str] = UNIVERSAL_COLUMNS) -> DataFrame:
    """Texts only: the fixed columns, then the others by name; nested values as JSON text, null as blank."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return with_extras(df.withColumns(nested) if nested else df, columns)


def write_csv(df: DataFrame, target: str, columns: Sequence[str] = UNIVERSAL_COLUMNS) -> None:
    """CSV parts with header, minimal quoting and blanks for null; one file per partition."""
    export_frame(df, columns).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(target)


def read_csv(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(target)


def decoded_json(df: DataFrame, fields: Sequence[str] = JSON_FIELDS) -> DataFrame:
    """Fields of JSON text as values; blank and other texts become null."""
    have = {c for c, t in df.dtypes if t == "string"}
    return df.withColumns({c: F.try_parse_json(F.when(F.col(c).rlike(r"^\s*[\[{]"), F.col(c))) for c in fields if c in have})


def write_json(df: DataFrame, target: str) -> None:
    """JSON lines with nested values."""
    decoded_json(df).write.mode("overwrite").json(target)


def raw_audit(df: DataFrame) -> DataFrame:
    """Identity columns and the whole raw record as JSON text."""
    names = [F.col(c).cast("string").alias("product_id" if c == "id" else c) for c in RAW_COLUMNS if c in df.columns]
    return df.select(*names, F.to_json(F.struct("*")).alias("raw_json"))


def append_done(items: DataFrame, key: str, target: str) -> None:
    """Adds the keys that are done; nothing is rewritten."""
    items.select(F.col(key).cast("string").alias("item_key")).filter("item_key is not null").distinct().write.mode("append").parquet(target)


def read_done(spark: SparkSession, target: str) -> DataFrame:
    """The keys done so far; empty if there are none yet."""
    try:
        return spark.read.parquet(target)
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER" in str(problem):
            return spark.createDataFrame([], "item_key string")
        raise


def failure_log(df: DataFrame) -> DataFrame:
    """(product_url, reason, status_code, timestamp, stage) of failures."""
    return df.select("product_url", "reason", "status_code", F.col("failed_at").alias("timestamp"), "stage")


def quality_report(counters: Mapping[str, int], source: str) -> str:
    """The report's text from one row of counters."""
    head = ["DATA QUALITY REPORT", f"Source: {source}", "-" * 40]
    return "\n".join(head + [f"{label:<22}{counters.get(name, 0):>12}" for label, name in REPORT_LINES]) + "\n"

"""From pages to clean records, as one plan: analyze, discover, limit, resume, extract, normalize, keep first, audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators import dataset
from shelfspark.plans.adapters import ADAPTERS, Adapter, analyze
from shelfspark.plans.normalize import normalize_records
from shelfspark.session import materialize


def _ways(adapters: Sequence[Adapter], what: str) -> list[tuple[Callable[[DataFrame], DataFrame], list[str]]]:
    """Each function once, with the adapters that share it, so that their pages go through one plan."""
    ways: dict = {}
    for one in adapters:
        ways.setdefault(getattr(one, what), []).append(one.name)
    return list(ways.items())


def discover(pages: DataFrame, adapters: Sequence[Adapter] = ADAPTERS) -> DataFrame:
    """(url, seq, item_url) of all listing pages, each by its adapter."""
    tagged = analyze(pages, adapters).filter("page_type <> 'Product' and unsafe = ''")
    parts = []
    for way, names in _ways(adapters, "discover"):
        found = way(tagged.filter(F.col("adapter").isin(*names)).select("url", "html"))
        item = "item_url" if "item_url" in found.columns else "product_url"
        parts.append(found.select("url", F.col("seq").cast("bigint").alias("seq"), F.col(item).alias("item_url")))
    return dataset.union_pages(parts)


def extract(pages: DataFrame, adapters: Sequence[Adapter] = ADAPTERS) -> DataFrame:
    """Records of all product pages, each by its adapter."""
    tagged = analyze(pages, adapters).filter("page_type = 'Product' and unsafe = ''")
    parts = [way(tagged.filter(F.col("adapter").isin(*names)).select("url", "html")) for way, names in _ways(adapters, "extract")]
    return dataset.union_pages(parts)


def run(pages: DataFrame, done: DataFrame | None = None, limit: int | None = None, adapters: Sequence[Adapter] = ADAPTERS, **toggles: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, dead letters, audit) of the product pages among ``pages``.

    ``done`` holds ``item_key`` of pages that an earlier run of the job finished. A page that yields no record is a dead letter.
    """
    wanted = analyze(pages, adapters).filter("page_type = 'Product'")
    if done is not None:
        wanted = dataset.resume_skip(wanted, done.select(F.col("item_key").alias("url")), "url")
    if limit:
        wanted = dataset.first_records(wanted, ["url"], limit)
    safe = wanted.select("url", "html", "unsafe")
    raw = materialize(extract(safe.select("url", "html"), adapters))
    records = normalize_records(raw.withColumnRenamed("url", "source_url"))
    kept = dataset.keep_first(records.withColumn("_order", F.col("source_url")), dataset.record_key("product_url"), "_order").drop("_order")
    dead = safe.join(raw.select("url").distinct(), "url", "left_anti")
    dead = dead.select(F.col("url").alias("product_url"), F.when(F.col("unsafe") != "", F.concat(F.lit("unsafe_"), "unsafe")).otherwise("no_record").alias("reason"), F.lit(None).cast("int").alias("status_code"), F.lit("extraction").alias("stage"))
    return dataset.blank_fields(kept, **toggles), dead, dataset.integrity_audit(kept)

"""Operators on whole tables of items and records: keep-first, limits, resume, lookups, fallbacks, audits.

Order is always explicit. Keep-first is an aggregation (least order value) joined back, or a window where the whole ranking is
wanted; both split hot keys or combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.scalar import filled, first_filled


def record_key(*columns: str) -> Column:
    """The first filled of the columns; null if all are blank."""
    return first_filled(*(F.col(c).cast("string") for c in columns))


def keep_first(df: DataFrame, key: Column, order: str, keep_blank: bool = True) -> DataFrame:
    """The row of the least ``order`` for each key. Rows without key stay (or go, if ``keep_blank`` is false).

    ``order`` must be unique within a key. A key of any number of rows combines before the shuffle: only the least order
    value moves, and the rows are found again by it.
    """
    keyed = df.withColumn("_key", key)
    firsts = keyed.filter("_key is not null").groupBy("_key").agg(F.min(order).alias("_first")).select("_key", "_first")
    kept = keyed.join(firsts, (keyed["_key"] == firsts["_key"]) & (keyed[order] == firsts["_first"]), "left_semi").drop("_key")
    return kept.unionByName(keyed.filter("_key is null").drop("_key")) if keep_blank else kept


def duplicates_removed(df: DataFrame, key: Column) -> DataFrame:
    """One row: rows in, rows that keep-first leaves, duplicates."""
    counted = df.select(key.alias("_key")).agg(
        F.count("*").alias("rows_in"), (F.countDistinct("_key") + F.count_if(F.col("_key").isNull())).alias("rows_kept")
    )
    return counted.withColumn("duplicates", F.col("rows_in") - F.col("rows_kept"))


def keep_first_cards(df: DataFrame, url: str, name: str, order: str) -> DataFrame:
    """First per address, then first per name."""
    return keep_first(keep_first(df, filled(F.col(url)), order), filled(F.col(name)), order)


def first_records(df: DataFrame, order: Sequence[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows in order; all for None or 0."""
    return df.orderBy(*order).limit(limit) if limit else df


def last_of_each(df: DataFrame, by: str, order: Sequence[str], size: int) -> DataFrame:
    """The last ``size`` rows of each group, a bounded log. Groups larger than memory sort outside it."""
    window = Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") <= size).drop("_place")


def resume_skip(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key isn't done yet; items without key stay."""
    return items.join(done.select(F.col(key).alias("_done")).distinct(), F.col(key) == F.col("_done"), "left_anti")


def resume_merge(saved: DataFrame, fresh: DataFrame, same_job: bool) -> DataFrame:
    """Saved rows ahead of fresh ones where both belong to one job; else the fresh ones."""
    tagged = fresh.withColumn("part", F.lit(1))
    return saved.withColumn("part", F.lit(0)).unionByName(tagged, allowMissingColumns=True) if same_job else tagged


def collection_titles(products: DataFrame, collections: DataFrame, id_col: str, tags: str) -> DataFrame:
    """(id, collection): titles of the collections of the same shop whose handle is among the product's tags, in order of handle."""
    tagged = products.select(id_col, "source_domain", F.explode(F.transform(F.col(tags), lambda t: F.lower(F.replace(F.trim(t), F.lit(" "), F.lit("-"))))).alias("handle"))
    found = tagged.distinct().join(collections.select("source_domain", "handle", F.col("title").alias("_title")), ["source_domain", "handle"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("handle", "_title"))), lambda x: x["_title"])
    return found.groupBy(id_col).agg(F.array_join(ordered, ", ").alias("collection"))


def matching_collections(collections: DataFrame, text: str) -> DataFrame:
    """The first collection of each shop, by handle, whose title or handle contains the text."""
    like = F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("handle"), F.lit(text.lower()))
    first = F.min(F.struct("handle", "title")).alias("first")
    return collections.filter(like).groupBy("source_domain").agg(first).select("source_domain", "first.handle", "first.title")


def store_lookup(df: DataFrame, shops: DataFrame, value: str) -> DataFrame:
    """A shop's value for each row, by one small lookup per shop rather than per row; null for unknown shops."""
    one = shops.groupBy("source_domain").agg(F.min(value).alias(value))
    return df.join(one, "source_domain", "left")


def first_strategy(df: DataFrame, page: str, rank: str) -> DataFrame:
    """The rows of the best strategy that found anything for a page."""
    best = df.groupBy(page).agg(F.min(rank).alias("_best"))
    return df.join(best, page).filter(F.col(rank) == F.col("_best")).drop("_best")


def largest_early_class(df: DataFrame, page: str, name: str, position: str, least: int = 3) -> DataFrame:
    """For each page the class with at least ``least`` members that begins first."""
    grouped = df.groupBy(page, name).agg(F.count("*").alias("members"), F.min(position).alias("first_position")).filter(F.col("members") >= least)
    chosen = F.min(F.struct("first_position", name, "members")).alias("c")
    return grouped.groupBy(page).agg(chosen).select(page, f"c.{name}", "c.members", "c.first_position")


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""


def integrity_audit(df: DataFrame) -> DataFrame:
    """One row of counters of missing fields, in one pass."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(_blank("product_name") & _blank("title")).alias("missing_title"),
        F.count_if(_blank("price")).alias("missing_price"),
        F.count_if(_blank("description")).alias("missing_description"),
        F.count_if(_blank("main_image") & _blank("image_url")).alias("missing_image"),
        F.count_if(_blank("category")).alias("missing_category"),
        F.count_if(_blank("sku")).alias("missing_sku"),
        F.count_if(F.coalesce("variant_count", F.lit(0)) > 0).alias("has_variants"),
    )


def column_audit(df: DataFrame) -> DataFrame:
    """The audit of single columns that older exports have: no second column stands in for a missing one."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(_blank("product_name")).alias("missing_title"),
        F.count_if(_blank("image_url")).alias("missing_image"),
        F.count_if(~_blank("variants")).alias("has_variants"),
    )


def run_stats(items: DataFrame, records: DataFrame, failures: DataFrame, key: Column) -> DataFrame:
    """One row: discovered, scraped, failed, duplicates_removed."""
    parts = (
        items.agg(F.count("*").alias("discovered")),
        duplicates_removed(records, key).select(F.col("rows_kept").alias("scraped"), F.col("duplicates").alias("duplicates_removed")),
        failures.agg(F.count("*").alias("failed")),
    )
    names = ("discovered", "scraped", "duplicates_removed", "failed")
    long = None
    for part in parts:
        for column in part.columns:
            one = part.select(F.lit(column).alias("name"), F.col(column).alias("n"))
            long = one if long is None else long.unionByName(one)
    return long.groupBy().agg(*(F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names))


def blank_fields(df: DataFrame, images: bool = True, variants: bool = True, descriptions: bool = True) -> DataFrame:
    """Fields that a run leaves out, blanked."""
    changes: dict[str, Column] = {}
    if not images:
        changes |= {c: F.lit("") for c in ("main_image", "additional_images", "all_images", "image_url")}
    if not variants:
        changes |= {"variants": F.lit(""), "variant_count": F.lit(0)}
    if not descriptions:
        changes |= {c: F.lit("") for c in ("description", "short_description")}
    return df.withColumns({k: v for k, v in changes.items() if k in df.columns})


def preview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the named columns that exist."""
    return df.select(*(c for c in columns if c in df.columns))


def with_extras(df: DataFrame, fixed: Sequence[str]) -> DataFrame:
    """The fixed columns in order, missing ones blank, then all others sorted by name, as texts."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in fixed]
    extra = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(set(df.columns) - set(fixed))]
    return df.select(*named, *extra)


def union_pages(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def split_failures(df: DataFrame, value: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters): a row without a value goes to the dead letters with the reason."""
    good = df.filter(F.col(value).isNotNull())
    return good, df.filter(F.col(value).isNull()).withColumn("reason", F.lit(reason))


def catalog_summary(df: DataFrame, columns: Mapping[str, str], order: str, size: int = 20) -> DataFrame:
    """One row: number of records and a text of the first ``size``, one line each (a report of fixed size)."""
    line = F.concat_ws(" | ", *(F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c, label in columns.items()))
    first = df.select(F.col(order).alias("_o"), line.alias("_line")).orderBy("_o").limit(size)
    text = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_line"))), lambda x: x["_line"]), "\n").alias("summary"))
    return df.agg(F.count("*").alias("records")).join(F.broadcast(text))

"""One surviving record for each group of captures of a listing, field by field.

Captures are grouped by the addresses and ids that tell the same listing of the same shop, transitively. Within a group the
rows are ranked field by field: only usable values compete, then the ranking terms (completeness, trust, recency) decide
in the order given, and the smallest row id breaks ties.

The ranking is a window over (group, field) in its order; its first row is computed as the least ranking tuple, which
combines before the shuffle, so that a group that holds a third of all rows stays cheap. :func:`rank_records` gives the whole
ranking by the window itself.

Rows without any address or id are groups of their own. Null instants rank last. A field without usable values has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.listing import address_id, instant_micros, listing_id, product_path, shop_key
from shelfspark.functions.plain import is_stand_in
from shelfspark.llm.residue import residue
from shelfspark.operators.graph import connected_components
from shelfspark.operators.skew import join_hot
from shelfspark.operators.units import states_amount
from shelfspark.session import materialize

SURVIVOR_FIELDS = ("product_name", "description", "price", "brand", "availability", "main_image")


def listing_keys() -> Column:
    """The ids and product addresses that tell a row's listing within its shop, sorted; empty without any.

    A hash of 128 bits stands for shop and key; a clash is out of reach of any corpus.
    """
    shop = shop_key(F.col("source_domain"))
    names = (
        F.concat(F.lit("id "), listing_id(F.col("product_id"))),
        F.concat(F.lit("id "), address_id(F.col("product_url"))),
        F.concat(F.lit("id "), address_id(F.col("source_url"))),
        F.concat(F.lit("at "), product_path(F.col("product_url"))),
        F.concat(F.lit("at "), product_path(F.col("source_url"))),
    )
    # No lambda, which would be interpreted: nulls sort first and are sliced off.
    hashed = [F.unhex(F.md5(F.concat(shop, F.lit(" "), n))) for n in names]
    ordered = F.sort_array(F.array_distinct(F.array(*hashed)))
    missing = F.when(F.get(ordered, 0).isNull(), 1).otherwise(0)
    return F.slice(ordered, missing + 1, F.lit(len(hashed)))


def kind_of(keys: Column, row: Column) -> Column:
    """Two hashes of the keys; a row without keys is of its own kind."""
    own = F.struct(F.xxhash64(row).alias("a"), F.lit(-1).cast("bigint").alias("b"))
    return F.when(F.size(keys) > 0, F.struct(F.xxhash64(keys).alias("a"), F.xxhash64(F.lit(7), keys).alias("b"))).otherwise(own)


def listing_kinds(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(kind, listing): rows that capture the same listing of the same shop; the listing's id is its smallest row id.

    Rows with the same keys are one item to the component search, so that copies of a capture add nothing to it. Rows without keys don't appear.
    """
    keys = F.col("keys") if df.columns == [id_col, "keys"] else listing_keys()
    keyed = df.select(F.col(id_col).alias("item"), keys.alias("keys")).filter(F.size("keys") > 0)
    kinds = materialize(keyed.groupBy("keys").agg(F.min("item").alias("item")))
    components = connected_components(kinds.select("item", F.explode("keys").alias("key")))
    return kinds.join(components, "item").select(kind_of(F.col("keys"), F.col("item")).alias("kind"), F.col("component").alias("listing"))


def with_listing(rows: DataFrame, kinds: DataFrame, id_col: str = "row_id") -> DataFrame:
    """``rows``, which have a column ``kind``, with their ``listing`` in its place; a row of no known kind is its own listing."""
    return join_hot(rows, kinds, "kind", "left").withColumn("listing", F.coalesce("listing", id_col)).drop("kind")


def listing_groups(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(row id, group_row_id) of all rows."""
    rows = df.select(id_col, kind_of(listing_keys(), F.col(id_col)).alias("kind"))
    return with_listing(rows, listing_kinds(df, id_col), id_col).withColumnRenamed("listing", "group_row_id")


def usable(field: str) -> Column:
    value = F.col(field).cast("string")
    ok = ~is_stand_in(value)
    return ok & states_amount(value) if field == "price" else ok


def completeness(df: DataFrame, fields: Sequence[str]) -> Column:
    """How many of the fields hold a value."""
    total = F.lit(0)
    for f in fields:
        total = total + F.when(is_stand_in(F.col(f).cast("string")), 0).otherwise(1)
    return total


def rank_records(df: DataFrame, groups: DataFrame, id_col: str, order: Sequence[Column]) -> DataFrame:
    """All records with ``place`` (1 is best) within their group by ``order``, then the smallest id."""
    window = Window.partitionBy("group_row_id").orderBy(*order, F.col(id_col).asc())
    return df.join(groups, id_col).withColumn("place", F.row_number().over(window))


def surviving_values(df: DataFrame, id_col: str = "row_id", fields: Sequence[str] = SURVIVOR_FIELDS) -> DataFrame:
    """(group_row_id, field_name, from_row_id): the row that each field's surviving value comes from, for groups of two or more."""
    texts = [f for f in ("product_name", "description") if f in fields]
    offered = F.array_compact(F.array(*(F.when(usable(f), F.lit(f)) for f in fields)))
    rows = df.select(id_col, listing_keys().alias("keys"), instant_micros(F.col("scraped_at").cast("string")).alias("instant"), offered.alias("offered"))
    # Keys are read from the addresses once.
    rows = materialize(rows.withColumn("kind", kind_of(F.col("keys"), F.col(id_col))))
    kinds = listing_kinds(rows.select(id_col, "keys"), id_col)
    rows = rows.drop("keys")
    if texts:
        bad = residue(df, id_col, texts).groupBy(id_col).agg(F.collect_set("field_name").alias("bad"))
        rows = rows.join(bad, id_col, "left").withColumn("offered", F.when(F.col("bad").isNull(), F.col("offered")).otherwise(F.array_except("offered", "bad")))
    placed = with_listing(rows, kinds, id_col)
    # Latest instant, then smallest id: the least of (-instant, id), where a missing instant is last.
    rank = F.struct((-F.coalesce("instant", F.lit(-(2**62)))).alias("late"), F.col(id_col).alias("id"))
    best = placed.groupBy(F.col("listing").alias("group_row_id")).agg(
        F.count("*").alias("n"), *(F.min(F.when(F.array_contains("offered", f), rank)).alias(f"best_{f}") for f in fields)
    )
    chosen = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"best_{f}")["id"].alias("from_row_id")) for f in fields))
    return best.filter("n > 1").select("group_row_id", F.inline(chosen)).filter("from_row_id is not null")


def surviving_records(df: DataFrame, id_col: str = "row_id", fields: Sequence[str] = SURVIVOR_FIELDS) -> DataFrame:
    """One record per group of two or more rows, built from the surviving values."""
    chosen = surviving_values(df, id_col, fields)
    values = df.select(F.col(id_col).alias("from_row_id"), F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string")))).alias("_m"))
    picked = chosen.join(values, "from_row_id").select("group_row_id", "field_name", F.col("_m")[F.col("field_name")].alias("value"))
    return picked.groupBy("group_row_id").agg(*(F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields))

"""Connected components of a bipartite graph of items and keys, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import discard, materialize

#: Rounds after which the search is given up as broken; labels jump, so this covers chains of far more than 2^60 items.
MAX_ROUNDS = 100


def connected_components(links: DataFrame, item: str = "item", key: str = "key") -> DataFrame:
    """(item, component) from links (item, key): items that share a key, directly or through others, are one component.

    ``component`` is the least item. Items are integers, keys of any type; null keys link nothing, and items without links
    don't appear. Each round gives every key the least label of its items and every item the least label of its keys, with a
    jump to the label of its label. Minima combine before the shuffle and are written before they are joined back, so that AQE can split a
    key that a third of all items share.
    """
    edges = materialize(links.select(F.col(item).alias("item"), F.col(key).alias("key")).filter("item is not null and key is not null").distinct())
    # Only keys of several items carry labels onwards.
    least = materialize(edges.groupBy("key").agg(F.min("item").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    inner = materialize(edges.join(least, "key"))
    labels = materialize(inner.groupBy("item").agg(F.min("least").alias("label")))
    discard(least)
    inner = inner.select("item", "key")
    for _ in range(MAX_ROUNDS):
        by_key = materialize(inner.join(labels, "item").groupBy("key").agg(F.min("label").alias("least")))
        spread = inner.join(by_key, "key").groupBy("item").agg(F.min("least").alias("least"))
        parents = labels.select(F.col("item").alias("label"), F.col("label").alias("up"))
        jumped = spread.join(labels, "item").join(parents, "label", "left")
        new = materialize(jumped.select("item", F.least("least", "label", F.coalesce("up", "label")).alias("new"), F.col("label").alias("old")))
        changed = new.filter("new <> old").limit(1).count()
        discard(by_key, labels)
        if not changed:
            lone = edges.select("item").distinct().join(new, "item", "left_anti").select("item", F.col("item").alias("component"))
            return new.select("item", F.col("new").alias("component")).unionByName(lone)
        scratch = new._scratch
        labels = new.select("item", F.col("new").alias("label"))
        labels._scratch = scratch
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")

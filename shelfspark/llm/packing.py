"""Filling fixed-capacity containers with items of whole sizes: best fit decreasing, in supersteps over runs of one size.

Documents are range-sorted by size; each knows its rank among those of its size. The supersteps run in a loop on the driver, over the
histogram of sizes: only ranks and their lookup are distributed. Open containers are kept by their gap. A
superstep takes the documents of one size, largest first, sweeps the gaps upwards from that size for the successors, gives
the documents to them by rank (so no two documents can claim one place), and updates the gaps; documents without a gap open
new containers.

Sizes and gaps are whole numbers up to the capacity, so both sides are kept as runs (size, ranks) and (gap, containers): a
superstep works on runs, its cost doesn't depend on the number of documents, and only the histogram of sizes, at most one
count for each size up to the capacity, reaches the driver. Documents are never collected; they meet the resulting runs by an equi-join
on size.

A document larger than the capacity is split: whole containers first, its rest is packed like the others. Empty documents
take no room: they have one piece of no tokens in no container (null). Ties are broken by id.
"""

from __future__ import annotations

import bisect
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import materialize

#: Runs above this number are joined by a shuffle instead of a broadcast.
BROADCAST_RUNS = 500_000


def best_fit_runs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first_rank, last_rank, first_bin, per_bin) of a best-fit-decreasing packing, and the number of containers."""
    gaps: dict[int, deque[tuple[int, int]]] = {}
    order: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap <= 0 or count <= 0:
            return
        if gap not in gaps:
            gaps[gap] = deque()
            bisect.insort(order, gap)
        gaps[gap].append((first, count))

    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, count = gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first, count = capacity, bins, -1
            per = gap // size
            if count < 0:
                count = -(-left // per)
                bins += count
            full = min(count, left // per)
            if full:
                runs.append((size, rank, rank + full * per - 1, first, per))
                rank += full * per
                left -= full * per
                put(gap - per * size, first, full)
                first, count = first + full, count - full
            if count and 0 < left < per:
                runs.append((size, rank, rank + left - 1, first, left))
                put(gap - left * size, first, 1)
                rank, left = rank + left, 0
                first, count = first + 1, count - 1
            put(gap, first, count)
    return runs, bins


def _no_pieces(sizes: DataFrame, id_col: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return sizes.limit(0).select(
        F.lit(0).alias("container_id"), zero.alias("bin_id"), id_col, F.lit(0).alias("piece_no"), zero.alias("token_start"), zero.alias("piece_tokens")
    )


def pack_kinds(sizes: DataFrame, kinds: dict[int, int], id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(container_id, bin_id, id, piece_no, token_start, piece_tokens): a packing of all items for each kind of container.

    ``kinds`` gives the capacity of each container id. All kinds are sorted, counted and placed together.
    """
    spark = sizes.sparkSession
    if not kinds:
        return _no_pieces(sizes, id_col)
    if min(kinds.values()) < 1:
        raise ValueError("capacities must be at least 1")
    each = F.array(*(F.struct(F.lit(k).cast("int").alias("container_id"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(kinds.items())))
    base = sizes.select(F.col(id_col).alias("_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("n"), F.inline(each))
    base = base.select("container_id", "capacity", "_id", "n", F.floor(F.col("n") / F.col("capacity")).alias("whole"), (F.col("n") % F.col("capacity")).cast("int").alias("size"))
    order = ["container_id", "size", "_id"]
    position = F.monotonically_increasing_id()
    ordered = base.repartitionByRange(*order).sortWithinPartitions(*order)
    # Part and place are written with the rows, since a table is read back in other partitions.
    placed = materialize(ordered.select("*", F.shiftright(position, 33).alias("part"), position.bitwiseAND((1 << 33) - 1).alias("place")))
    # One pass: counts by partition, kind and size; their number is bounded by partitions plus capacities, since it is sorted.
    counts = placed.groupBy("part", "container_id", "size").agg(F.count("*").alias("n"), F.max("whole").alias("whole")).collect()
    parts: dict[int, int] = {}
    histograms: dict[int, dict[int, int]] = {k: {} for k in kinds}
    longest = dict.fromkeys(kinds, 0)
    for r in counts:
        parts[r["part"]] = parts.get(r["part"], 0) + r["n"]
        own = histograms[r["container_id"]]
        own[r["size"]] = own.get(r["size"], 0) + r["n"]
        longest[r["container_id"]] = max(longest[r["container_id"]], r["whole"] or 0)
    before, starts = 0, []
    for part in sorted(parts):
        starts.append((part, before))
        before += parts[part]
    smaller, firsts, runs, totals = 0, [], [], []
    for kind in sorted(kinds):
        for size in sorted(histograms[kind]):
            firsts.append((kind, size, smaller))
            smaller += histograms[kind][size]
        own_runs, bins = best_fit_runs({s: n for s, n in histograms[kind].items() if s > 0}, kinds[kind])
        runs += [(kind, *r) for r in own_runs]
        totals.append((kind, bins, longest[kind]))
    starts_df = spark.createDataFrame(starts or [(0, 0)], "part bigint, before bigint")
    firsts_df = spark.createDataFrame(firsts or [(0, 0, 0)], "container_id int, size int, smaller bigint")
    totals_df = spark.createDataFrame(totals, "container_id int, bins bigint, longest bigint")
    runs_df = spark.createDataFrame(runs, "run_kind int, run_size int, low bigint, high bigint, first_bin bigint, per_bin bigint")
    runs_df = F.broadcast(runs_df) if len(runs) <= BROADCAST_RUNS else runs_df
    ranked = placed.join(F.broadcast(starts_df), "part").withColumn("index", F.col("before") + F.col("place"))
    ranked = ranked.join(F.broadcast(firsts_df), ["container_id", "size"]).withColumn("rank", F.col("index") - F.col("smaller"))
    fits = (F.col("container_id") == F.col("run_kind")) & (F.col("size") == F.col("run_size")) & F.col("rank").between(F.col("low"), F.col("high"))
    rest = ranked.filter("size > 0").join(runs_df, fits)
    rest = rest.select(
        "container_id",
        (F.col("first_bin") + F.floor((F.col("rank") - F.col("low")) / F.col("per_bin"))).alias("bin_id"),
        F.col("_id").alias(id_col),
        F.col("whole").cast("int").alias("piece_no"),
        (F.col("whole") * F.col("capacity")).alias("token_start"),
        F.col("size").cast("bigint").alias("piece_tokens"),
    )
    # Whole containers of split documents follow the packed ones (their ids are unique, with gaps); empty ones have none.
    others = ranked.filter("whole > 0 or n = 0").join(F.broadcast(totals_df), "container_id")
    others = others.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("whole").cast("int") - 1, F.lit(0)))).alias("piece_no")).select(
        "container_id",
        F.when(F.col("n") > 0, F.col("bins") + F.col("index") * F.col("longest") + F.col("piece_no")).alias("bin_id"),
        F.col("_id").alias(id_col),
        "piece_no",
        F.col("piece_no") * F.col("capacity"),
        F.when(F.col("n") > 0, F.col("capacity")).otherwise(0).cast("bigint"),
    )
    return rest.union(others)


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(bin_id, id, piece_no, token_start, piece_tokens) of every item for containers of one capacity."""
    return pack_kinds(sizes, {0: capacity}, id_col, size_col).drop("container_id")


def pack_all(sizes: DataFrame, containers: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """The packing for each row of ``containers`` (container_id, capacity_tokens); the least capacity of a repeated id."""
    named = containers.filter("container_id is not null and capacity_tokens > 0").groupBy("container_id").agg(F.min("capacity_tokens").alias("capacity"))
    kinds = {r["container_id"]: r["capacity"] for r in named.limit(1001).collect()}
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    return pack_kinds(sizes, kinds, id_col, size_col)


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, bins, bound, tokens, filled): containers used, the least number that could hold the tokens, and the part of their room that is used."""
    room = containers.filter("capacity_tokens > 0").groupBy("container_id").agg(F.min("capacity_tokens").cast("bigint").alias("capacity"))
    used = packed.filter("bin_id is not null").groupBy("container_id", "bin_id").agg(F.sum("piece_tokens").alias("tokens"))
    totals = used.groupBy("container_id").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens")).join(F.broadcast(room), "container_id")
    return totals.select("container_id", "bins", F.ceil(F.col("tokens") / F.col("capacity")).alias("bound"), "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("filled"))


def faults(packed: DataFrame, sizes: DataFrame, containers: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(container_id, documents, wrong_documents, overfull): documents whose pieces aren't their tokens, once each and in order, and containers above their capacity.

    Ids must be unique here.
    """
    room = containers.filter("capacity_tokens > 0").groupBy("container_id").agg(F.min("capacity_tokens").cast("bigint").alias("capacity"))
    pieces = packed.groupBy("container_id", id_col).agg(
        F.sum("piece_tokens").alias("n"), F.count("*").alias("pieces"), F.max("piece_no").alias("last"), F.max(F.col("token_start") + F.col("piece_tokens")).alias("end")
    )
    wanted = sizes.select(id_col, F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("size")).crossJoin(F.broadcast(room))
    right = (F.col("n") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("pieces") == F.col("last") + 1)
    right = right & (F.col("pieces") == F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)))
    checked = wanted.join(pieces, ["container_id", id_col], "left").groupBy("container_id").agg(
        F.count("*").alias("documents"), F.count_if(~F.coalesce(right, F.lit(False))).alias("wrong_documents")
    )
    over = packed.filter("bin_id is not null").groupBy("container_id", "bin_id").agg(F.sum("piece_tokens").alias("n")).join(F.broadcast(room), "container_id")
    over = over.groupBy("container_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    return checked.join(over, "container_id", "left").select("container_id", "documents", "wrong_documents", F.coalesce("overfull", F.lit(0)).alias("overfull"))

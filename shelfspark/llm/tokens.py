"""Encoding a corpus with a public byte-level tokenizer, and decoding.

Texts are split natively by the tokenizer's pattern. Each distinct word is encoded once: a higher-order fold over its byte
pieces applies the merge of the lowest rank until none is left, looking ranks up in a literal map that is laid out in buckets
by hash. Words above ``LONG_WORD`` bytes take the same merges from a heap in an Arrow function, since the fold is quadratic.

Words that make up at least ``1 / HOT_BOUND`` of the (text, word) pairs, at most ``HOT_BOUND`` of them, are put into the texts from
a second literal map without a shuffle; all rarer words meet their texts by an equi-join, where none of them is hot.

Null and empty texts have the empty list of ids. Strings of special tokens are ordinary text. Rows are never joined by their
own id, so repeated ids are no harm.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.skew import join_hot
from shelfspark.session import discard, materialize

BUCKETS = 8192
HOT_BOUND = 20_000
LONG_WORD = 64
#: Characters of a plan's description that are kept while literal maps are in plans.
PLAN_TEXT = 20_000
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = DEFAULT_RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _bucketed(entries: Iterator[tuple[str, object]], kind: str) -> Column:
    """A literal map as an array of small maps by the checksum of the key; folded to one literal by the optimizer."""
    buckets: list[dict[str, object]] = [{} for _ in range(BUCKETS)]
    for key, value in entries:
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = value
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")


def _lookup(table: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table, (F.crc32(key) % BUCKETS).cast("int")), key)


def split_words(text: Column, pattern: str | None = None) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + (pattern or split_pattern())), F.lit(0))


def fold_merges(word_hex: Column, ranks: Column) -> Column:
    """Ids of a word given as hexadecimal text, by repeated merges of the pair with the lowest rank."""
    size = (F.length(word_hex) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(word_hex, i * 2 + 1, F.lit(2)))

    def merge(state: Column, _: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(state) - 2), lambda i: _lookup(ranks, F.concat(F.get(state, i), F.get(state, i + 1)))
        )

        def at(place: Column) -> Column:
            joined = F.array(F.concat(F.get(state, place - 1), F.get(state, place)))
            return F.concat(F.slice(state, F.lit(1), place - 1), joined, F.slice(state, place + 2, F.size(state)))

        # One pass computes the ranks, a one-element transform names their minimum's first place.
        place = F.transform(F.array(pairs), lambda p: F.array_position(p, F.array_min(p)).cast("int"))
        return F.when(F.size(state) < 2, state).otherwise(
            F.get(F.transform(place, lambda at_: F.when(at_.isNull() | (at_ < 1), state).otherwise(at(at_))), 0)
        )

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), pieces, merge)
    whole = _lookup(ranks, word_hex)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, lambda p: _lookup(ranks, p)))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges from a heap with a linked list, for long words."""
    n = len(word)
    parts = [word[i : i + 1] for i in range(n)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[after[i]])))
        if before[i] >= 0 and (r := ranks.get(parts[before[i]] + parts[i])) is not None:
            heapq.heappush(heap, (r, before[i], len(parts[before[i]]) + len(parts[i])))
    return [ranks[parts[i]] for i in range(n) if alive[i]]


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Adds ``word_ids`` to a frame with a column ``word``."""
    ranks = _bucketed(((k.hex(), v) for k, v in read_ranks(path).items()), "int")
    sized = words.withColumn("_hex", F.lower(F.hex(F.encode("word", "UTF-8"))))
    short = sized.filter(F.length("_hex") <= 2 * LONG_WORD).withColumn("word_ids", fold_merges(F.col("_hex"), ranks)).drop("_hex")
    long = sized.filter(F.length("_hex") > 2 * LONG_WORD)

    def from_heap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = read_ranks(path)
        for batch in batches:
            batch["word_ids"] = [heap_merges(bytes.fromhex(h), table) for h in batch["_hex"]]
            yield batch.drop(columns="_hex")

    fields = ", ".join(f"`{c}` {t}" for c, t in words.dtypes)
    return short.unionByName(long.mapInPandas(from_heap, f"{fields}, word_ids array<int>"))


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text_col``; all rows stay."""
    path = path or vocabulary_path()
    # The literal maps would be printed with every plan that the driver keeps.
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(11), text).alias("b"))
    # Each text is split once.
    texts = materialize(df.select("*", key.alias("_key"), split_words(text).alias("_words")))
    counted = materialize(texts.select(F.explode(F.array_distinct("_words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    table = materialize(encode_words(counted, path))
    total = table.agg(F.sum("n").alias("n")).first()["n"] or 0
    is_hot = F.col("n") * HOT_BOUND >= F.lit(total)
    hot = [(r["word"], list(r["word_ids"])) for r in table.filter(is_hot).select("word", "word_ids").collect()]  # at most HOT_BOUND
    hot_ids = _bucketed(iter(hot), "array<int>")
    rare = table.filter(~is_hot).select("word", "word_ids")
    # Each word is looked up once. Only texts with a rarer word move; one text may hold a great part of the rows.
    looked = texts.withColumn("_parts", F.transform("_words", lambda w: _lookup(hot_ids, w)))
    looked = materialize(looked.withColumn("_words", F.when(F.exists("_parts", lambda p: p.isNull()), F.col("_words"))))
    discard(texts, counted)
    whole = looked.filter("_words is null").withColumn(out, F.flatten("_parts"))
    rest = looked.filter("_words is not null").withColumn("_parts", F.arrays_zip(F.col("_words").alias("w"), F.col("_parts").alias("p")))
    missing = rest.select("_key", F.explode(F.array_distinct(F.transform(F.filter("_parts", lambda x: x["p"].isNull()), lambda x: x["w"]))).alias("word"))
    found = missing.distinct().join(rare, "word").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "word_ids"))).alias("_rare"))
    joined = join_hot(rest, found, "_key").withColumn(out, F.flatten(F.transform("_parts", lambda x: F.coalesce(x["p"], F.try_element_at(F.col("_rare"), x["w"])))))
    return whole.select(*df.columns, out).unionByName(joined.select(*df.columns, out))


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: the binary pieces in order, read as UTF-8. Null for null ids."""
    ranks = read_ranks(path or vocabulary_path())
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")

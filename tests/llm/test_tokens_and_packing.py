import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm import tokens
from shelfspark.llm.packing import best_fit_runs, pack, pack_all

public = pytest.importorskip("public_tokenizers")
TEXTS = ["Hello world, it's 2031!", "", None, "  two  spaces\n\n\tand tabs ", "Größe 👩‍🍳 براہ کرم", "a" * 3000, "<|endoftext|>", "word " * 400, "it's", "\xa0　x", "it's"]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_and_round_trip(spark):
    df = spark.createDataFrame([(i % 10, t, "w") for i, t in enumerate(TEXTS)], "doc_id long, text string, word string")
    rows = tokens.encode(df.withColumn("n", F.monotonically_increasing_id())).withColumn("back", tokens.decode(F.col("ids"))).orderBy("n").collect()
    assert [list(r.ids) for r in rows] == reference(TEXTS)
    assert [r.back for r in rows] == [t or "" for t in TEXTS]
    assert tokens.encode(df.limit(0)).count() == 0


def test_rare_words_meet_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HOT_BOUND", 3)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = tokens.encode(df).orderBy("doc_id").collect()
    assert [list(r.ids) for r in rows] == reference(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=65, max_size=300))
def test_heap_merges(text):
    ranks = tokens.read_ranks(tokens.vocabulary_path())
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert tokens.heap_merges(text.encode("utf-8", "surrogatepass"), ranks) == encoding.encode_ordinary(text) or "\ud800" <= max(text)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15), st.integers(40, 64))
def test_runs_pack_every_item_once(histogram, capacity):
    runs, bins = best_fit_runs(histogram, capacity)
    fill = [0] * bins
    for size in histogram:
        own = sorted(r for r in runs if r[0] == size)
        assert [r[1] for r in own] == [0, *(r[2] + 1 for r in own[:-1])] and own[-1][2] == histogram[size] - 1
        for _, low, high, first, per in own:
            for rank in range(low, high + 1):
                fill[first + (rank - low) // per] += size
    assert all(0 < f <= capacity for f in fill)
    # Best fit leaves at most one container half empty.
    assert sum(2 * f <= capacity for f in fill) <= 1


def test_pack(spark):
    sizes = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, None), (5, 3), (6, 7), (6, 7), (7, 3)] + [(100 + i, 4) for i in range(200)], "doc_id long, n_tokens int")
    rows = pack(sizes, 10).collect()
    fill, first = {}, {}
    for r in rows:
        if r.bin_id is not None:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.piece_tokens
        first.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.piece_tokens))
    assert max(fill.values()) <= 10
    assert sorted(first[1]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert first[3] == [(0, 0, 0)] and sorted(first[6]) == [(0, 0, 7), (0, 0, 7)]
    assert sum(fill.values()) == 25 + 10 + 3 + 7 + 7 + 3 + 800
    kinds = spark.createDataFrame([(1, 10), (2, 100), (3, None)], "container_id int, capacity_tokens int")
    assert {r.container_id for r in pack_all(sizes, kinds).collect()} == {1, 2}
    assert pack_all(sizes.limit(0), kinds).count() == 0 and pack_all(sizes, kinds.limit(0)).count() == 0

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm.lookalike import UnionFind, lookalike_classes, plain_texts, representatives, rewrite_all


def test_cases():
    pairs = {
        "ara‌bic⁣a Coﬀee": "arabica Coffee", "Сhoiсe Nоnofabі": "Choice Nonofabi", "Ｓｍｏｏｔｈｉｅ Maker": "Smoothie Maker", "Möbrik": "Möbrik",
        "Α Élanova": "A Élanova", "Komegila": "Komegila", "a b": "a b", "Ιδανικό": "Ιδανικό",
    }
    assert rewrite_all(pairs) == list(pairs.values())


def test_what_stays():
    texts = ["Möbrik É ñ ß", "Для дома и кухни", "Ποιότητα κάθε μέρα", "👨‍👩‍👧 ½ ™ ★ °", "براہ کرم", "می‌خواهم", "a  b", "", None, "سوال؟ x"]
    assert rewrite_all(texts) == texts


def test_classes_are_transitive_and_disjoint():
    classes = lookalike_classes()
    members = [m for c in classes for m in c]
    assert len(members) == len(set(members))
    o = next(c for c in classes if "o" in c)
    assert {"о", "ο", "ｏ"} <= set(o)
    sets = UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        sets.union(a, b)
    assert sorted(map(len, sets.classes())) == [2, 4]


def test_frequency_decides_between_equally_plain_members():
    mu = next(c for c in lookalike_classes() if "ي" in c or "ﻱ" in c)
    assert representatives({m: 1 for m in mu})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abо́οеéｅ​‍ \xa0ﬁЖж👩ا‌", max_size=25))
def test_idempotent(text):
    once = rewrite_all([text])
    assert rewrite_all(once) == once


def test_rows(spark):
    df = spark.createDataFrame([(1, "Nоva", "plain"), (1, "Nоva", None), (2, "Nova", "x​y" * 3000)], "row_id long, product_name string, description string")
    got = plain_texts(df, "row_id", ["product_name", "description"]).filter("changed")
    assert sorted((r.row_id, r.field_name) for r in got.collect()) == [(1, "product_name"), (1, "product_name"), (2, "description")]
    assert plain_texts(df.limit(0), "row_id", ["product_name"]).count() == 0

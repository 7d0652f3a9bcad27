import json

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.operators.packed import Segmenter, split_values

KNOWN = {"red": 10, "Red, washed": 4, "A | B fit": 2, "blue": 9}


def test_marks():
    s = Segmenter(KNOWN)
    cases = {
        "red|blue": ["red", "blue"],
        "red , blue": ["red", "blue"],
        '["red", "blue"]': ["red", "blue"],
        "['red', 'Men\\'s']": ["red", "Men's"],
        "red;;blue": ["red", "blue"],
        "|red||blue|": ["red", "blue"],
        "Red, washed|blue": ["Red, washed", "blue"],
        "A | B fit | blue": ["A | B fit", "blue"],
        '"buy 2; get 1";blue': ["buy 2; get 1", "blue"],
        "wash\\, dry,blue": ["wash, dry", "blue"],
        'the ""x"" y': ['the ""x"" y'],
        '"the ""x"" y", red': ['the "x" y', "red"],
        "Black/White / red": ["Black/White", "red"],
        "red\nblue": ["red", "blue"],
        "red blue": ["red blue"],
        "https://a.b/c_1,g_2/x.jpg,https://a.b/y.jpg": ["https://a.b/c_1,g_2/x.jpg", "https://a.b/y.jpg"],
        "//a.b/x.jpg //a.b/y.jpg": ["//a.b/x.jpg", "//a.b/y.jpg"],
        "red, red": ["red", "red"],
        "": [],
        "|,;": [],
    }
    for text, values in cases.items():
        assert s.split(text) == values, text
    assert s.split(None) == []
    assert len(s.split("|".join(["x" * 50] * 5000))) == 5000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["red", "blue", "Red, washed", "A | B fit", "5-piece", 'say "x"']), min_size=1, max_size=6), st.sampled_from(["json", "quoted", "escaped"]), st.sampled_from([",", "|", ";"]))
def test_round_trip(values, way, mark):
    if way == "json":
        text = json.dumps(values)
    elif way == "quoted":
        text = mark.join('"' + v.replace('"', '""') + '"' for v in values)
    else:
        text = mark.join("".join("\\" + c if c in ",|;\"" else c for c in v) for v in values)
    assert Segmenter(KNOWN).split(text) == values


def test_rows(spark):
    df = spark.createDataFrame([(1, "a|b", None), (2, "n/a", " "), (3, '["x", "y, z"]', "y, z|a"), (3, '["x", "y, z"]', "-")], "row_id long, tags string, sizes string")
    got = sorted((r.row_id, r.field_name, r.item_pos, r.item_value) for r in split_values(df, "row_id", ["tags", "sizes"]).collect())
    assert got == sorted(
        [(1, "tags", 0, "a"), (1, "tags", 1, "b"), (3, "sizes", 0, "y"), (3, "sizes", 1, "z"), (3, "sizes", 2, "a")] + [(3, "tags", 0, "x"), (3, "tags", 1, "y, z")] * 2
    )
    assert split_values(df.limit(0), "row_id", ["tags"]).count() == 0


def test_rare_values_are_protected_at_every_size(spark, monkeypatch):
    from shelfspark.operators import packed

    rows = [(1, '["Black, White", "Red"]'), (2, "Red, Black, White"), (3, "Black, White | Red"), (4, "White, Black")] + [(10 + i, '["Red", "Blue"]') for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, colors string")

    def values(bound):
        monkeypatch.setattr(packed, "DICTIONARY_BOUND", bound)
        got = {}
        for r in packed.split_values(df, "row_id", ["colors"]).collect():
            got.setdefault(r.row_id, {})[r.item_pos] = r.item_value
        return {i: [v for _, v in sorted(x.items())] for i, x in got.items() if i < 10}

    # With a bound of 3 the dictionary that goes to the workers holds two values.
    assert values(3) == values(20_000) == {1: ["Black, White", "Red"], 2: ["Red", "Black, White"], 3: ["Black, White", "Red"], 4: ["White", "Black"]}

from pyspark.sql import functions as F

from shelfspark.llm.product_match import accessory_of, article_codes, base_values, brand_key, plain_key, quantities, same_item_classes, same_item_pairs, sku_codes, spell_counts

SCHEMA = "row_id long, source_domain string, product_id string, product_url string, source_url string, sku string, product_name string, title string, description string, brand string, vendor string, specifications string"


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def measures(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.explode(quantities(spell_counts(plain_key(F.col("t"))))).alias("written"))
    out = {}
    for r in base_values(df).collect():
        out.setdefault(r.t, []).append(r.token)
    return out


def test_tokens(spark):
    q = {"kettle 0.5 litre": "ml:500.000", "22.05 lbs beans": "g:10000.000", "10KG": "g:10000.000", 'rug 78.7"': "mm:2000.000", "set of 8": "pc:8.000", "eight-piece": "pc:8.000", "2200Watts": "w:2200.000", "101.4fl. oz": "ml:3000.000", "20000mAh": "mah:20000.000", "512 gigabyte": "gb:512.000"}
    assert measures(spark, [*q, "plain mug"]) == {text: [value] for text, value in q.items()}
    assert one(spark, lambda c: article_codes(plain_key(c)), "Mug (AB/12345) cd 54321, of 10000 g") == ["ab12345", "cd54321"]
    assert one(spark, lambda c: article_codes(plain_key(c)), "SKU xk-204b, 400 mm 2031 edition, desk light400mm, 4k7720 and 4006381333931") == ["xk204b", "4k7720", "4006381333931"]
    assert one(spark, sku_codes, "BRI-ZG34309") == ["brizg34309", "rizg34309", "izg34309", "zg34309", "g34309"] and one(spark, sku_codes, "n/a") == []
    # Near values part, whatever their size; a rounded number stands for the roundest one it can.
    apart = ("125 g", "128 g", "130 g", "134 g", "454 g", "455 g", "256 GB", "260 GB", "20000 mAh", "20400 mAh")
    assert len({v for (v,) in measures(spark, apart).values()}) == len(apart)
    assert set(map(tuple, measures(spark, ("8.5 fl oz", "0.25 l", "25cl", "250ml")).values())) == {("ml:250.000",)}
    assert one(spark, plain_key, "Poem of a poet, Bo\u0308rse") == "poem of a poet, boerse"
    assert {one(spark, brand_key, b) for b in ("Möbrik", "MOEBRIK", "Mö-brik GmbH", "Möbrik Co.")} == {"moebrik"}
    assert one(spark, brand_key, "n/a") is None
    assert one(spark, lambda c: accessory_of(plain_key(c)), "Carry case for Altinell YA 63850") == "carry case"
    assert one(spark, lambda c: accessory_of(plain_key(c)), "Flash Card for 4K video") == ""


def item(i, shop, name, brand="Nova", code=None, description=None):
    return (i, shop, str(i), None, None, code, name, None, description, brand, None, None)


ROWS = [
    item(1, "a.example", "Nova Sedirepo kettle 1 l AB12345"),
    item(2, "b.example", "SEDIREPO water boiler | Nova 1000ml"),
    item(3, "c.example", "boiler nova ab-12345 red"),
    item(4, "d.example", "Nova Sedirepo kettle 2 l CD54321"),
    item(5, "e.example", "Carry case for Nova AB12345"),
    item(6, "a.example", "Nova Sedirepo kettle 1 l AB12345 NEW"),
    item(7, "b.example", None, None),
    item(8, "f.example", "Sedirepo kettle 1 l", "Other"),
    item(9, "g.example", "Carry case for NOVA ab 12345"),
    item(10, "h.example", "Other kettle 1 l", "Other"),
]


def test_pairs(spark):
    got = {(r.row_id_a, r.row_id_b) for r in same_item_pairs(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert {(1, 3), (3, 6), (5, 9)} <= got
    assert not any({a, b} & {4, 7, 10} for a, b in got) and (1, 6) not in got
    assert all(a < b for a, b in got)


def test_classes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    pairs = same_item_pairs(df).collect()
    partners = {}
    for r in pairs:
        partners.setdefault(r.row_id_a, set()).add(r.row_id_b)
        partners.setdefault(r.row_id_b, set()).add(r.row_id_a)
    got = {r.row_id: (r.class_id, r.links) for r in same_item_classes(df).collect()}
    assert {i: n for i, (_, n) in got.items()} == {i: len(p) for i, p in partners.items()}
    assert all(got[i][0] == got[j][0] for i, p in partners.items() for j in p)


def test_short_names_and_large_clusters(spark):
    short = [item(1, "1.example", "Nova Zu kettle 1 l"), item(2, "2.example", "kettle Zu by Nova, 33.8 fl oz")]
    many = [item(1000 + i, f"{i % 7}.example", "Nova Mirabel press 2 kg") for i in range(700)]
    fill = [item(10 + k, f"{k}.example", f"Brand{k} kettle press", f"Brand{k}") for k in range(9)]
    got = {(r.row_id_a, r.row_id_b) for r in same_item_pairs(spark.createDataFrame(short + many + fill, SCHEMA)).collect()}
    assert got == {(1, 2)} | {(1000 + a, 1000 + b) for a in range(700) for b in range(a + 1, 700) if a % 7 != b % 7}


def test_a_series_name_of_two_brands(spark):
    nova = [item(i, f"{i}.example", f"Nova Sedirepo kettle 1 l {c}") for i, c in enumerate(("red", "blue", "grey", "green"), 1)]
    other = [item(i, f"{i}.example", f"Sedirepo {c} lamp 5 w by Other", "Other") for i, c in enumerate(("red", "blue", "grey"), 11)]
    stray = [item(20, "20.example", "Sedirepo kettle 1 l", "Third")]
    fill = [item(100 + 10 * b + k, f"{k}.example", f"Brand{b} {w} kettle 1 l {c}", f"Brand{b}") for b, w in enumerate(("mirabel", "tundora", "velosta", "quandel")) for k, c in enumerate(("green", "yellow"))]
    bare = [item(200 + k, f"{k}.example", f"{c} kettle 1 l", "Nova") for k, c in enumerate(("small", "large"))]
    rows = spark.createDataFrame(nova + other + stray + fill + bare, SCHEMA)
    got = {(r.row_id_a, r.row_id_b) for r in same_item_pairs(rows).collect() if r.row_id_a < 100 or r.row_id_b >= 200}
    assert got == {(a, b) for group in ((1, 2, 3, 4), (11, 12, 13)) for a in group for b in group if a < b}


def test_a_series_named_late_in_the_description(spark):
    late = "Made for daily use at home and on the road, easy to clean and kept in stock all year, and it belongs to our Sedirepo family."
    named = [item(i, f"{i}.example", "Nova Sedirepo kettle 1 l") for i in (1, 2)]
    silent = [item(3, "3.example", "Nova water boiler 1 l", description=late)]
    coded = [item(4, "4.example", "Nova Mirabel press AB12345"), item(5, "5.example", "Nova coffee maker", description="A press. " * 30 + "Article AB 12345.")]
    # What a title says outweighs other numbers in the text below.
    sure = [item(6, "6.example", "Nova Tundora fan CD54321", description="KeyError at 11111, again at 11111"), item(7, "7.example", "Nova fan cd-54321")]
    fill = [item(100 + k, f"{k}.example", f"Brand{k} water kettle 1 l", f"Brand{k}") for k in range(9)]
    got = {(r.row_id_a, r.row_id_b) for r in same_item_pairs(spark.createDataFrame(named + silent + coded + sure + fill, SCHEMA)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (4, 5), (6, 7)}


def test_nulls_and_clashing_columns(spark):
    blank = tuple([None] * 12)
    df = spark.createDataFrame([*ROWS[:3], blank, ROWS[0]], SCHEMA)
    more = df.selectExpr("*", "row_id as group_row_id", "brand as word", "sku as cluster", "row_id as listing", "sku as shop")
    assert {(r.row_id_a, r.row_id_b) for r in same_item_pairs(more).collect()} >= {(1, 3)}


def test_empty(spark):
    assert same_item_pairs(spark.createDataFrame([], SCHEMA)).count() == 0

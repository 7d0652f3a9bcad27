from shelfspark.llm.residue import residue

CASES = {
    "Curtain {{ product.title }} 1 m": "slot", "Mug %BRAND% red": "slot", "${vendor} lamp": "slot", "[[[brand | default]]] mug": "slot", "<INSERT PRICE>": "slot", "Lamp __ITEM_DESCRIPTION__": "slot",
    "{% if title %} x": "slot", "Shop @@Vendor@@ now": "slot", "[PRODUCT_NAME]": "slot", "Please enable JavaScript to view this page.": "script", "Activa JavaScript en tu navegador para continuar.": "script",
    "404 Not Found\nBack to shop": "error", "502 Bad Gateway nginx <hr><center>web</center>": "error", "Sorry, you have been blocked Your IP has been logged.": "error", "Seite nicht gefunden": "error",
    "Lorem ipsum dolor sit amet": "filler", "asdf asdf asdf": "filler", "TODO write copy": "filler", "undefined undefined - NaN": "filler", "[object Object]": "filler", "ＡＣＣＥＳＳ ＤＥＮＩＥＤ": "error",
    "Curly {brace} enamel mug": None, "JavaScript for Quiet Evenings (paperback)": None, "404 Not Found printed T-shirt": None, "Placeholder cards for wedding tables": None, "100% Wool Test-drive sock": None,
    "Blank notebook - insert your own title": None, "Save 10% on sets of two [while stocks last].": None, 'Printed with the words "Access Denied" on the back.': None, "n/a": None, "": None, " ": None, "-": None,
    "Error proof knitting counter": None, "Lorem Ipsum typographic poster": None, "word " * 20000: None,
    # Messages in words that no list of whole messages holds.
    "404 Not Found nginx/1.18": "error", "Please turn JavaScript on to see this": "script", "Dieses Produkt ist nicht verfügbar": "error", "Mug {% include 'a very long name of a partial that goes on for more than eighty characters in one tag' %}": "slot",
    "We're sorry, but this page doesn't work properly without JavaScript enabled": "script", "The product you requested could not be found": "error", "Enter the product description here": "filler",
}


def test_cases_with_copies(spark):
    rows = [(i, t, None) for i, t in enumerate(CASES)] + [(1000 + i, "Access Denied", "fine mug") for i in range(50)] + [(5000, None, None)]
    df = spark.createDataFrame(rows, "row_id long, product_name string, description string")
    got = {r.row_id: r.verdict for r in residue(df, "row_id", ["product_name", "description"]).collect()}
    for i, (text, verdict) in enumerate(CASES.items()):
        assert got.get(i) == verdict, text[:80]
    assert all(got[1000 + i] == "error" for i in range(50)) and 5000 not in got


def test_slots_of_templates_and_own_brands(spark):
    names = ["Kettle", "Lamp", "Rug", "Mug", "Jar", "Scarf", "Shelf", "Drill", "Cable"]
    rows = [(i, f"s{i}.example", f"Brand{chr(97 + i)}x", f"Sorry, we couldn't find the {n} you requested") for i, n in enumerate(names)]
    rows += [(100 + i, f"s{i}.example", "Norvell", f"Norvell error {n} not found edition") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "row_id long, source_domain string, brand string, product_name string")
    got = {r.row_id: r.verdict for r in residue(df, "row_id", ["product_name"]).collect()}
    # The names stand in a slot; what names the brand of its own record is no message.
    assert got == {i: "error" for i in range(len(names))}


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "Page not found", "k", "l")], "row_id long, product_name string, key string, leaf string")
    assert [r.verdict for r in residue(df, "row_id", ["product_name"]).collect()] == ["error"]
    assert residue(df.limit(0), "row_id", ["product_name"]).count() == 0

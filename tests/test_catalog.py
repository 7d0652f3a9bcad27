import os

import pytest

duckdb = pytest.importorskip("duckdb")

NAMES = ["canonical_url", "page_classification", "html_to_text", "price_and_currency", "packed_count", "storefront_records", "storefront_variants", "dedupe_keep_first", "resume_skip", "dead_letters", "window_goods"]


@pytest.fixture(scope="module")
def connection(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def plain(value):
    return None if value is None or value != value else round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, connection, name):
    from shelfspark.plans import catalog

    df = catalog.queries()[name](spark, sf_dir)
    found = connection.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == expected


def test_core_does_not_import_the_text_package():
    import subprocess
    import sys

    code = "import sys, shelfspark, shelfspark.plans.catalog, shelfspark.plans.preparation; sys.exit(any(m.startswith('shelfspark.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__)), check=False).returncode == 0


def test_every_row_by_brute_force(spark, tmp_path):
    import json
    import re

    from shelfspark.plans import catalog

    a, b, c = "https://c.example/w_300,h_200/1.webp", "//c.example/2_300x300.jpg", "https://c.example/2.jpg?v=12"
    listed = [a, b, c]
    forms = [json.dumps(listed), str(listed), "|".join(listed), "||".join(listed), " | ".join(listed), ", ".join(listed), "\t".join(listed), " ; ".join(listed), ",".join(f'"{x}"' for x in listed), a, None, " ", "N/A"]
    names = ["Caf\xe9\xa0 Lamp", "\u2007Mug\u2009| ", "\u062c\u06cc\u06a9\u0679", "top pick", "Kettle\u200b 1 l", "Plain  name,", "Topf\u3000x", None, "", "-", "a\x1fb", "D\xe9cor Pick\x85", "x"]
    prices = ["1000", "999", "10.50", "1,299", "Rs 1299", "12.99 USD", "Sold out", None, "", "0", "$5", "12 - 15", "1299 - 1499"]
    spark.createDataFrame(list(zip(range(13), forms, names, prices)), "row_id long, all_images string, product_name string, price string").write.parquet(f"{tmp_path}/products.parquet")

    def images(text):
        found = [a] if text == a else listed if text and "c.example" in text else []
        out = []
        for u in (re.sub(r"_[0-9]+x[0-9]*\.(jpg|png|webp|jpeg)", r".\1", "https:" + x if x.startswith("//") else x) for x in found):
            if u.split("?")[0] not in [o.split("?")[0] for o in out]:
                out.append(u)
        return (out[0] if out else "", "|".join(out[1:]), "|".join(out))

    def title(name):
        if name is None:
            return None
        t = re.sub(r"(?i)^\s*top\s*pick\s*", "", f"Top pick {name} Opens in new tab.")
        return re.sub(r"\s+", " ", re.sub(r"(?i)\s*opens?\s+in\s+(?:a\s+)?new\s+tab\.?\s*$", "", t)).strip(" ,|-")

    def amount(text):
        m = re.search(r"\d[\d,]*(?:\.\d+)?", (text or "").split(" - ")[0])
        return None if not m else float(m.group().replace(",", "")) / (100 if len(text) > 3 and "." not in text else 1)

    def got(name):
        return [tuple(r)[1:] for r in sorted(catalog.queries()[name](spark, str(tmp_path)).collect())]

    assert got("image_lists_every_row") == [images(x) for x in forms]
    assert got("anchor_title_every_row") == [(title(x),) for x in names]
    assert got("minor_units_every_row") == [(amount(x),) for x in prices]

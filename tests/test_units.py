from fractions import Fraction

import pytest

from shelfspark.operators.units import ConversionGraph, convert, usd_cents

P = "row_id long, source_domain string, price string, original_price string, currency string, shipping_information string, short_description string, description string, price_source string"


def test_graph():
    g = ConversionGraph().add("C", "K", 1, Fraction("273.15")).add("F", "C", Fraction(5, 9), Fraction(-160, 9)).add("m", "cm", 100)
    mul, add = g.to("K")["F"]
    assert mul * 212 + add == Fraction("373.15")
    assert g.to("cm")["m"] == (100, 0) and g.to("m")["cm"] == (Fraction(1, 100), 0)
    g.check_cycles()
    g.add("F", "K", 1, 1)
    with pytest.raises(ValueError):
        g.check_cycles()
    with pytest.raises(ValueError):
        g.add("a", "b", 0)


def test_convert_rounds_half_up(spark):
    g = ConversionGraph().add("a", "b", Fraction(1, 8)).add("c", "b", Fraction(-1, 2))
    df = spark.createDataFrame([("4", "a"), ("12", "a"), ("3", "c"), (None, "a"), ("1", "zzz"), ("0.1", "b")], "v string, u string").selectExpr("cast(v as decimal(24,6)) v", "u")
    got = {(str(r.v), r.u): r.out for r in convert(df, g.table(spark, ["b"]), "v", "u", "b", "out").collect()}
    assert got[("4.000000", "a")] == 1 and got[("12.000000", "a")] == 2 and got[("0.100000", "b")] == 0
    assert got[("None", "a")] is None and got[("1.000000", "zzz")] is None


def test_amounts(spark):
    rows = [
        ("$10.50", None, None, None, None, 1050), ("C$10", None, None, None, None, 731), ("$10", "CAD", None, None, None, 731), ("$10", None, None, None, None, 1000),
        ("1.234,50 EUR", None, None, None, None, 133746), ("99,99", "EUR", None, None, None, 10833), ("1,234", "USD", None, None, None, 123400), ("1999", "USD", None, "wc_store_api.prices.price", None, 1999),
        ("19.99", "USD", None, "wc_store_api.prices.price", None, 1999), ("500 euro cents", None, None, None, None, 542), ("75 K", "USD", None, None, None, 7500000), ("PKR 1.1 lac", None, None, None, None, 39490),
        ("12.5", None, "Listed in thousands of Japanese yen.", None, None, 8388), ("10 - 20 USD", None, None, None, None, 1000), ("From $5", None, None, None, None, 500), ("۵۵,۱۵۱.۷۵ روپے", None, None, None, None, 19799),
        ("Rs. 100", None, None, None, "INR", 119), ("Sold out", None, None, None, None, None), ("", None, None, None, None, None), (None, None, None, None, None, None), ("20% off", None, None, None, None, None),
        ("USD 999999999999999999", None, None, None, None, None), ("999999999999 crore", "INR", None, None, None, None), ("USD 91000000000000000.01", None, None, None, None, 9100000000000000001), ("USD 92233720368547758.08", None, None, None, None, None),
        ("5", None, "All prices in pounds sterling.", None, None, 634), ("100", "JPY", None, "rawData.priceInfo.price", None, 67), ("Ｕ＄７", None, None, None, None, 700),
    ]
    df = spark.createDataFrame([(i, f"s{i}", r[0], None, r[1], r[2], None, None, r[3]) for i, r in enumerate(rows)], P)
    shops = spark.createDataFrame([(f"s{i}", r[4] or "USD") for i, r in enumerate(rows)], "source_domain string, store_currency string")
    units = spark.createDataFrame(
        [("USD", 100, 1000000), ("EUR", 100, 1083400), ("GBP", 100, 1267100), ("INR", 100, 11930), ("JPY", 1, 6710), ("PKR", 100, 3590), ("CAD", 100, 731200), ("AUD", 100, 655900)],
        "code string, minor_per_major int, usd_micros long",
    )
    got = {r.row_id: r.usd_cents for r in usd_cents(df, shops, units).collect()}
    for i, r in enumerate(rows):
        assert got.get(i) == r[-1], r
    assert usd_cents(df.limit(0), shops, units).count() == 0
    assert usd_cents(df, shops.limit(0), units).count() > 10

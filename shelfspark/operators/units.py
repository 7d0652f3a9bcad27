"""Quantities in different units and scales: a conversion graph, and amounts read from text.

Units are nodes and conversions are edges with affine functions ``target = mul * source + add`` over exact rationals.
:class:`ConversionGraph` checks that every cycle is the identity and precomputes the shortest composition from each unit
to each canonical target; :func:`convert` equi-joins rows with that table on source unit and target.

:func:`usd_cents` reads an amount, its currency and its scale from texts, names the unit (``USD.minor``, ``JPY.k`` ...) and
converts to US cents. Values that state no amount (null, blank, words only), or one of 10^18 or more, or one of more than ``GREATEST`` cents, have no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.plain import fold_lookalikes, squeeze

#: A unit table larger than this is refused: it is read by the driver and broadcast.
MAX_UNITS = 10_000
#: Converted values beyond this, the room of a bigint, are null.
GREATEST = 9.2e18


class ConversionGraph:
    """Affine conversions between units; inverse edges are implied."""

    def __init__(self) -> None:
        self.edges: dict[str, dict[str, tuple[Fraction, Fraction]]] = {}

    def add(self, source: str, target: str, mul: Fraction | int, add: Fraction | int = 0) -> ConversionGraph:
        mul, add = Fraction(mul), Fraction(add)
        if mul == 0:
            raise ValueError(f"{source} to {target}: a factor of 0 can't be inverted")
        self.edges.setdefault(source, {})[target] = (mul, add)
        self.edges.setdefault(target, {}).setdefault(source, (1 / mul, -add / mul))
        return self

    def to(self, target: str) -> dict[str, tuple[Fraction, Fraction]]:
        """The shortest composition from every unit that reaches ``target``, by breadth-first search from the target."""
        if target not in self.edges:
            return {target: (Fraction(1), Fraction(0))}
        found = {target: (Fraction(1), Fraction(0))}
        queue = deque([target])
        while queue:
            unit = queue.popleft()
            mul, add = found[unit]
            for other in sorted(self.edges[unit]):
                if other not in found:
                    m, a = self.edges[other][unit]
                    found[other] = (mul * m, mul * a + add)
                    queue.append(other)
        return found

    def check_cycles(self) -> None:
        """Every edge must agree with the composed functions of its ends; hence every cycle is the identity."""
        done: set[str] = set()
        for root in sorted(self.edges):
            if root in done:
                continue
            potential = self.to(root)
            done |= set(potential)
            for source in potential:
                for target, (mul, add) in self.edges[source].items():
                    m, a = potential[target]
                    if (m * mul, m * add + a) != potential[source]:
                        raise ValueError(f"inconsistent conversions on a cycle through {source} and {target}")

    def table(self, spark: SparkSession, targets: Iterable[str]) -> DataFrame:
        """(source_unit, target_unit, mul_num, mul_den, add_num, add_den) of all compositions."""
        self.check_cycles()
        rows = [
            (s, t, str(m.numerator), str(m.denominator), str(a.numerator), str(a.denominator))
            for t in targets
            for s, (m, a) in sorted(self.to(t).items())
        ]
        names = ("mul_num", "mul_den", "add_num", "add_den")
        raw = spark.createDataFrame(rows, "source_unit string, target_unit string, " + ", ".join(f"{n} string" for n in names))
        return raw.withColumns({n: F.col(n).cast("decimal(18,0)") for n in names})


def convert(df: DataFrame, table: DataFrame, value: str, unit: str, target: str, out: str) -> DataFrame:
    """Add ``out``, the exact value in ``target`` rounded half up to an integer; unknown units, null values and results beyond ``GREATEST`` give null.

    ``value`` is a decimal of at most six places.
    """
    wanted = table.filter(F.col("target_unit") == target).select(
        F.col("source_unit").alias("_unit"), *(F.col(n).alias(f"_{n}") for n in ("mul_num", "mul_den", "add_num", "add_den"))
    )
    scaled = df.withColumn("_scaled", (F.col(value) * 1_000_000).cast("decimal(28,0)")).join(F.broadcast(wanted), F.col(unit) == F.col("_unit"), "left")
    # floor((2 (v m + a) + 1) / 2) over the common denominator, in integers.
    top = "(2 * (_scaled * _mul_num * _add_den + 1000000 * _add_num * _mul_den) + 1000000 * _mul_den * _add_den)"
    bottom = "(2000000 * _mul_den * _add_den)"
    exact = F.expr(f"cast(floor(cast({top} as decimal(38,0)) / cast({bottom} as decimal(38,0))) as bigint)")
    whole = F.expr(f"cast({top} as decimal(38,0)) div cast({bottom} as decimal(38,0))")
    # What a bigint or 38 digits can't hold is null: a double tells it, and the exact way isn't taken.
    dens = F.expr("cast(_mul_den as double) * cast(_add_den as double)")
    about = F.abs(F.col(value).cast("double") * F.expr("cast(_mul_num as double) / cast(_mul_den as double)")) + F.abs(F.expr("cast(_add_num as double) / cast(_add_den as double)"))
    fits = (about < GREATEST) & (about * dens < 1e31) & (dens < 1e31)
    rounded = F.when(fits & (F.col(value) >= 0), whole).when(fits, exact)
    return scaled.withColumn(out, rounded).drop("_scaled", "_unit", "_mul_num", "_mul_den", "_add_num", "_add_den")


# How a currency is written, in order; a pattern that several currencies share has no code.
CURRENCY_WORDS: tuple[tuple[str, str], ...] = (
    ("USD", r"\busd|us ?\$|u\.s\.? ?\$|\bus cents?\b|\bus[- ]dollars?\b|\bu\.?s\.? dollars?\b"),
    ("CAD", r"\bcad|\bca? ?\$|canadian"),
    ("AUD", r"\baud|\bau? ?\$|australian"),
    ("EUR", r"\beur|€|\beuros?\b"),
    ("GBP", r"\bgbp|£|\bpounds?\b|\bsterling\b|\bpence\b|\d ?p\b|\bquid\b"),
    ("INR", r"\binr|₹|\bindian\b"),
    ("PKR", r"\bpkr|\bpak(?:istani?)?\b"),
    ("JPY", r"\bjpy|¥|￥|\byens?\b|円"),
    ("CHF", r"\bchf|\bs?fr\.|\bs?fr\b|\bfrancs?\b|\bswiss\b"),
    ("AED", r"\baed|\bdhs?\b|\bdhs?\.|\bdirhams?\b|د\.إ|درهم"),
)
# Signs that several currencies share, and those currencies, the usual one first.
SHARED_SIGNS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("dollar", r"\$|\bdollars?\b", ("USD", "CAD", "AUD")),
    ("rupee", r"₨|\brs\b|\brs\.|\brupees?\b|روپے|روپیہ|रु", ("PKR", "INR")),
    ("cent", r"¢|\bcents?\b|\bct\b", ("USD", "EUR", "CAD", "AUD")),
)
_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९٫٬’", "012345678901234567890123456789.,'")
_NUMBER = r"\d[\d.,' ]*\d|\d"


def _plain(text: Column) -> Column:
    return F.lower(squeeze(F.translate(fold_lookalikes(text), *_DIGITS)))


def currency_of(plain_text: Column) -> Column:
    """The code that the text names, or ``~sign`` for a sign that several currencies share, or null."""
    out = F.lit(None).cast("string")
    for sign, pattern, _ in reversed(SHARED_SIGNS):
        out = F.when(plain_text.rlike(pattern), F.lit(f"~{sign}")).otherwise(out)
    for code, pattern in reversed(CURRENCY_WORDS):
        out = F.when(plain_text.rlike(pattern), F.lit(code)).otherwise(out)
    return out


def _fits(code: Column, sign: Column) -> Column:
    """The code may be meant by the shared sign; a null sign fits every code."""
    ok = sign.isNull()
    for name, _, codes in SHARED_SIGNS:
        ok = ok | ((sign == f"~{name}") & code.isin(*codes))
    return ok


def resolve_currency(stated: Sequence[Column]) -> Column:
    """The first code among ``stated`` that agrees with the shared signs before it; else the usual one of the first sign."""
    sign, out = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in stated:
        is_code = one.isNotNull() & ~one.startswith("~")
        out = F.coalesce(out, F.when(is_code & _fits(one, sign), one))
        sign = F.coalesce(sign, F.when(one.startswith("~"), one))
    usual = F.lit(None).cast("string")
    for name, _, codes in SHARED_SIGNS:
        usual = F.when(sign == f"~{name}", F.lit(codes[0])).otherwise(usual)
    return F.coalesce(out, usual)


def _number(token: Column) -> Column:
    """A number in any of the usual notations as decimal(24,6); null if it has none."""
    t = F.regexp_replace(F.trim(token), r"[' ]", "")
    t = F.regexp_replace(t, r"[.,]+$", "")
    last_dot = F.length(t) - F.length(F.substring_index(t, ".", -1))
    last_comma = F.length(t) - F.length(F.substring_index(t, ",", -1))
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    comma_decimal = (
        F.when((commas > 0) & (dots > 0), last_comma > last_dot)
        .when(commas == 1, ~t.rlike(r",\d{3}$"))
        .otherwise(F.lit(False))
    )
    dot_groups = (commas == 0) & (dots > 1)
    as_comma = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    as_dot = F.replace(t, F.lit(","), F.lit(""))
    return F.when(comma_decimal | dot_groups, as_comma).otherwise(as_dot).try_cast("decimal(24,6)")


def read_amounts(df: DataFrame, id_col: str, columns: Sequence[str], *, currency: str, notes: Sequence[str], source: str, store: str) -> DataFrame:
    """(id, field_name, amount, unit): the lower end of each stated amount with its unit (``CODE``, ``CODE.minor`` or ``CODE.k``).

    ``currency``, ``notes`` and ``store`` are asked in that order where the value leaves the currency open. ``source`` names
    where the price was taken from; interfaces that count in the smallest unit give bare integers in it.
    """
    note = _plain(F.concat_ws(" . ", *(F.col(n).cast("string") for n in notes)))
    # Sentences about money: only they speak for the amounts.
    billing = F.array_join(
        F.filter(
            F.split(note, r"(?<=[.!?])\s"),
            lambda s: s.rlike(r"\b(?:prices?|amounts?|we bill|billed|listed|quoted|charged|payable|invoiced|currency)\b"),
        ),
        " ",
    )
    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("_raw")) for c in columns))
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.lower(F.coalesce(F.col(source), F.lit(""))).alias("_source"),
        currency_of(_plain(F.col(currency))).alias("_stated"),
        currency_of(billing).alias("_noted"),
        billing.rlike(r"\bthousands?\b").alias("_thousands"),
        currency_of(_plain(F.col(store))).alias("_store"),
        F.inline(fields),
    ).filter(F.col("_raw").rlike(r"\p{Nd}"))
    rows = rows.withColumn("_text", F.regexp_replace(_plain(F.col("_raw")), r"\d[\d.,]*\s*%", " "))
    parts = rows.withColumn(
        "_amounts",
        F.filter(
            F.transform(
                F.regexp_extract_all("_text", F.lit(rf"({_NUMBER})\s*(thousand|lakhs?|lacs?|millions?|crores?|k\b|l\b|m\b)?"), F.lit(0)),
                lambda m: (
                    _number(F.regexp_extract(m, _NUMBER, 0))
                    * F.when(m.rlike(r"\d\s*(?:thousand|k)$"), 1000).when(m.rlike(r"\d\s*(?:lakhs?|lacs?|l)$"), 100_000).when(m.rlike(r"(?:millions?|m)$"), 1_000_000).when(m.rlike(r"crores?$"), 10_000_000).otherwise(1)
                ).try_cast("decimal(24,6)"),
            ),
            lambda a: a.isNotNull(),
        ),
    ).filter(F.size("_amounts") > 0)
    is_range = F.col("_text").rlike(r"\d[^\d]*(?: - |–|—|\bto\b|\bbis\b|~)[^\d]*\d")
    written = currency_of(F.col("_text"))
    code = resolve_currency([F.col("_written"), F.col("_stated"), F.col("_noted"), F.col("_store")])
    bare = F.col("_text").rlike(r"^\d+$")
    minor = F.col("_text").rlike(r"¢|\bcents?\b|\bpence\b|\d ?p\b|\bct\b") | (
        bare & (F.col("_source").contains("wc_store_api") | F.col("_source").rlike(r"priceinfo\.price$"))
    )
    scaled = F.col("_text").rlike(r"\d\s*(?:thousand|lakhs?|lacs?|millions?|crores?|k\b|l\b|m\b)")
    unwritten = F.col("_text").rlike(r"^[\d.,' ]+$")
    return (
        parts.withColumn("_written", written)
        .withColumn("amount", F.when(is_range, F.array_min("_amounts")).otherwise(F.col("_amounts")[0]))
        .withColumn("_code", code)
        .select(
            F.col("_id").alias(id_col),
            "field_name",
            "amount",
            F.when(minor, F.concat("_code", F.lit(".minor")))
            .when(F.col("_thousands") & unwritten & ~scaled, F.concat("_code", F.lit(".k")))
            .otherwise(F.col("_code"))
            .alias("unit"),
        )
    )


def currency_graph(units: DataFrame) -> ConversionGraph:
    """Minor, major and thousand of each currency, and the dollar value of each major unit."""
    rows = units.select("code", "minor_per_major", "usd_micros").limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units of currency")
    graph = ConversionGraph()
    graph.add("US cent", "US dollar", Fraction(1, 100))
    for row in rows:
        if row["code"] is None or not row["minor_per_major"] or not row["usd_micros"]:
            continue
        code = row["code"].upper()
        graph.add(f"{code}.minor", code, Fraction(1, row["minor_per_major"]))
        graph.add(f"{code}.k", code, 1000)
        graph.add(code, "US dollar", Fraction(row["usd_micros"], 1_000_000))
    return graph


def usd_cents(
    products: DataFrame,
    shops: DataFrame,
    units: DataFrame,
    columns: Sequence[str] = ("price", "original_price"),
    notes: Sequence[str] = ("shipping_information", "short_description", "description"),
) -> DataFrame:
    """(row_id, field_name, usd_cents) of every value that states an amount. An unknown currency gives no row."""
    store = shops.groupBy(F.lower(F.trim("source_domain")).alias("_domain")).agg(F.min("store_currency").alias("_store_currency"))
    joined = products.withColumn("_domain", F.lower(F.trim("source_domain"))).join(store, "_domain", "left")
    amounts = read_amounts(joined, "row_id", columns, currency="currency", notes=notes, source="price_source", store="_store_currency")
    table = currency_graph(units).table(products.sparkSession, ["US cent"])
    out = convert(amounts, table, "amount", "unit", "US cent", "usd_cents")
    return out.filter(F.col("usd_cents").isNotNull()).select("row_id", "field_name", "usd_cents")


def states_amount(text: Column) -> Column:
    """The text holds a number that isn't only a percentage."""
    return F.coalesce(F.regexp_replace(_plain(text), r"\d[\d.,]*\s*%", " ").rlike(r"\d"), F.lit(False))

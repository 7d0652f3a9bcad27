"""Listings of different shops that describe one item: title combination voting.

Captures of one listing are pooled first. From the pooled titles and texts come tokens with their positions: brand, words, codes (any
token of letters and digits that is no measure) and quantities in a base unit. Tokens that don't tell brands apart take no part.
Each listing keeps its best word, code and quantity by the score of their combination with the brand, and from these generates all
k-combinations with the brand (k = 2 to 4). A combination scores by its length, the average position of its tokens and its
frequency over all listings; each listing votes for its best one. Elected combinations are verified over all listings that hold them (one code
and one quantity), and the clusters of verified combinations that one listing holds are merged.

No pairs are compared: groups form by equi-joins on combinations, statistics combine before the shuffle, and pairs are only
written at the end, since the result is defined as pairs; :func:`same_item_classes` gives classes instead.

Null and blank titles, listings without brand, or with neither a code nor a word of their own, stay alone. Ties between
combinations are broken by the combination itself. Copies of a row fall into its listing.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.listing import shop_key
from shelfspark.functions.plain import bare_letters, fold_beyond_ascii, is_ascii, is_stand_in, squeeze
from shelfspark.llm.survivors import kind_of, listing_keys, listing_kinds, with_listing
from shelfspark.operators.graph import connected_components
from shelfspark.operators.skew import join_hot
from shelfspark.session import materialize

# Units of sale by their spellings, their kind, how many base units they hold (g, ml, mm, W, mAh, GB, pieces), and whether a number in them is rounded.
UNITS: tuple[tuple[str, str, float, bool], ...] = (
    ("fl. oz|fl.oz|fl oz|floz|fluid ounce|fluid ounces", "ml", 29.5735, True), ("kg|kilo|kilos|kilogram|kilograms", "g", 1000.0, False), ("lb|lbs|pound|pounds", "g", 453.592, True),
    ("oz|ounce|ounces", "g", 28.3495, True), ("g|gr|gram|grams", "g", 1.0, False), ("ml|milliliter|milliliters|millilitre|millilitres", "ml", 1.0, False), ("cl", "ml", 10.0, False),
    ("l|ltr|liter|liters|litre|litres", "ml", 1000.0, False), ("mm|millimeter|millimeters|millimetre|millimetres", "mm", 1.0, False), ("cm|centimeter|centimeters|centimetre|centimetres", "mm", 10.0, False),
    ("m|meter|meters|metre|metres", "mm", 1000.0, False), ("in|inch|inches|\"|''|”", "mm", 25.4, True), ("ft|feet|foot", "mm", 304.8, True), ("kw|kilowatt|kilowatts", "w", 1000.0, False),
    ("w|watt|watts", "w", 1.0, False), ("mah|milliamp hour|milliamp hours", "mah", 1.0, False), ("ah|amp hour|amp hours", "mah", 1000.0, False), ("tb|terabyte|terabytes", "gb", 1000.0, False),
    ("gb|gigabyte|gigabytes", "gb", 1.0, False), ("mb|megabyte|megabytes", "gb", 0.001, False), ("pc|pcs|pce|piece|pieces", "pc", 1.0, False),
)
_NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
#: How far behind the title the tokens of a description count.
BEHIND_TITLE = 12
#: How far above chance two listings with a token must be of one brand, from 0 (as by chance) to 1 (always).
LEAST_EXCESS = 0.1
#: Words in at least this many rows, and one of so many rows, that don't tell brands apart are dropped before they move.
COMMON_FROM, COMMON_PART = 100, 20_000
#: Rows of a cluster that one task pairs with all others of it.
PAIRED_AT_ONCE = 500
_UNIT = "|".join(re.escape(u).replace("\\ ", " ") for u in sorted((u for names, *_ in UNITS for u in names.split("|")), key=lambda u: (-len(u), u)))
_QUANTITY = rf"(?=\d)(?<![\p{{L}}\p{{N}}./])(\d+(?:[.,]\d+)?) ?-?({_UNIT})(?![\p{{L}}\p{{N}}])"
# What is sold for an item rather than being it.
_ACCESSORY = (
    r"^((?:\p{L}+ ){0,4}?(?:lid|brush|case|kit|cover|strap|filter|part|parts|bag|pouch|charger|adapter|stand|holder|sleeve|refill|handle|blade|hose|mount|protector|battery|accessor(?:y|ies)))"
    r"(?: kit)?,? (?:for|suits|fits|compatible with|to fit)(?: the)? "
)
# Company forms at the end of a brand.
_COMPANY = r"[ ,]+(?:co|company|gmbh|ltd|limited|inc|llc|corp|srl|sl|sa|spa|ag|kg|bv|plc|pty)\.?$"
_COMPANY_WORDS = tuple(_COMPANY.split("(?:")[1].split(")")[0].split("|"))
_NO_UNIT = rf"(?! ?-?(?:{_UNIT})(?![\p{{L}}\p{{N}}]))"
# A short word and a number of at least three digits behind it, maybe with a mark or space between, or letters and digits in one; no measure.
_CODE = (
    r"(?<![\p{L}\p{N}.,/_-])(?=[a-z]{0,5}[ ./_-]?\d)"
    rf"(?:(?:(?!(?<=\d[ -])(?:{_UNIT}) )[a-z]{{1,3}} |[a-z]{{1,5}}[./_-]?)\d{{3,10}}(?!\d){_NO_UNIT}(?:(?<! \d{{3,10}})[a-z]{{1,3}}|)|\d{{1,6}}{_NO_UNIT}[a-z]{{1,4}}\d+[a-z0-9]*|\d{{7,14}}(?!\d){_NO_UNIT})(?![\p{{L}}\p{{N}}]|[.,]\d)"
)


def plain_key(text: Column) -> Column:
    """Lower case, plain characters, umlauts as two letters, no other accents, hyphens between letters closed."""
    # Each step names the one before it once: the code of an expression that is named twice is generated twice.
    key = F.regexp_replace(F.lower(fold_beyond_ascii(text)), "([aou])\u0308", "$1e")
    for mark, letters in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        key = F.replace(key, F.lit(mark), F.lit(letters))
    key = squeeze(F.when(is_ascii(text), F.lower(text)).otherwise(bare_letters(key)))
    return F.regexp_replace(key, r"-(?<=\p{L}{2}-)(?=\p{L})", "")


def brand_key(text: Column) -> Column:
    """Letters and digits of a brand without its company form; null for none."""
    key = F.regexp_replace(F.regexp_replace(plain_key(text), _COMPANY, ""), r"[^\p{L}\p{N}]+", "")
    return F.when(~is_stand_in(text), F.nullif(key, F.lit("")))


def article_codes(key: Column) -> Column:
    return F.transform(F.regexp_extract_all(key, F.lit(_CODE), F.lit(0)), lambda c: F.regexp_replace(c, r"[ ./_-]", ""))


def sku_codes(sku: Column) -> Column:
    """A number of the shop with each ending of the letters before its digits; only what some text says counts as a code."""
    bare = F.regexp_replace(F.lower(sku), r"[^a-z0-9]+", "")
    letters = F.length(F.regexp_extract(bare, r"^([a-z]*)\d{3,10}$", 1))
    endings = F.transform(F.sequence(F.lit(0), letters - 1), lambda i: F.substring(bare, i + 1, F.length(bare)))
    return F.when(bare.rlike(r"^[a-z]{1,12}\d{3,10}$"), endings).otherwise(F.array().cast("array<string>"))


def base_values(df: DataFrame) -> DataFrame:
    """Adds ``token``, the kind and value in base units of a ``written`` quantity, to a frame that has it; rows without a value are dropped.

    Each step is a projection of its own, so that none computes what another has.
    """
    spelled = [(u, kind, size, rounded) for names, kind, size, rounded in UNITS for u in names.split("|")]
    table = df.sparkSession.createDataFrame(spelled, "unit string, _kind string, _size double, _rounded boolean")
    number = F.regexp_extract("written", r"^[\d.,]*\d", 0)
    df = df.withColumn("_number", number).withColumn("unit", F.regexp_replace(F.expr("substring(written, length(_number) + 1)"), "^ ?-?", ""))
    df = df.join(F.broadcast(table), "unit").withColumn("_plain", F.translate("_number", ",", "."))
    places = F.when(F.contains("_plain", F.lit(".")), F.length(F.substring_index("_plain", ".", -1))).otherwise(0)
    df = df.withColumns({"_value": F.col("_plain").cast("double") * F.col("_size"), "_step": F.pow(F.lit(10.0), -places) * F.col("_size") / 2})
    off = F.when(F.col("_rounded"), F.least("_step", F.col("_value") / 100)).otherwise(F.lit(0.0))
    df = df.filter("_value > 0").withColumns({"_low": F.col("_value") - off, "_high": F.col("_value") + off})
    # Metric numbers stand as they are; of what a rounded number can stand for, the roundest metric one.
    round_ones = (F.when(F.ceil(F.col("_low") / 10.0**j) * 10.0**j <= F.col("_high"), F.ceil(F.col("_low") / 10.0**j) * 10.0**j) for j in range(5, -3, -1))
    df = df.withColumn("_exact", F.when(F.col("_low") == F.col("_high"), F.col("_value")).otherwise(F.coalesce(*round_ones, "_value")))
    token = F.concat("_kind", F.lit(":"), F.round("_exact", 3).cast("decimal(24,3)").cast("string"))
    return df.withColumn("token", token).drop("written", "unit", "_number", "_kind", "_size", "_rounded", "_plain", "_value", "_step", "_low", "_high", "_exact")


def spell_counts(key: Column) -> Column:
    """Piece counts in words, and sets of so many, as numbers of pieces."""
    spelled = key
    for i, word in enumerate(_NUMBER_WORDS):
        spelled = F.regexp_replace(spelled, rf"(?<!\p{{L}}){word}(?=[ -]?(?:piece|pc))", str(i + 1))
    pieces = F.contains(key, F.lit("piece")) | F.contains(key, F.lit("pc"))
    words = F.when(pieces & key.rlike(rf"(?:{'|'.join(_NUMBER_WORDS)})[ -]?(?:piece|pc)"), spelled).otherwise(key)
    counted = F.regexp_replace(words, r"(?<!\p{L})(?:set|pack|box) of (\d+)(?!\p{N})", "$1 piece")
    sets = F.contains(key, F.lit("set of ")) | F.contains(key, F.lit("pack of ")) | F.contains(key, F.lit("box of "))
    return F.when(sets, counted).otherwise(words)


def quantities(key: Column) -> Column:
    """Distinct written quantities of a text whose counts are spelled by :func:`spell_counts`; see :func:`base_values`."""
    return F.array_distinct(F.regexp_extract_all(key, F.lit(_QUANTITY), F.lit(0)))


def accessory_of(key: Column) -> Column:
    """The words that name an accessory at the beginning of a title, else an empty text."""
    return F.regexp_extract(key, _ACCESSORY, 1)


def brand_excess(pairs: DataFrame, brands: DataFrame) -> DataFrame:
    """(token, n, excess) from the counts ``f2`` of brand and token, and of brands alone.

    The excess is that of the chance that two uses of the token are of one brand over the same for any two.
    """
    f2, n = F.col("f2"), F.col("n")
    tokens = pairs.groupBy("token").agg(F.sum("f2").alias("n"), F.sum(f2 * (f2 - 1)).alias("same"), F.max("f2").alias("most"))
    chance = brands.agg((F.sum(f2 * (f2 - 1)) / F.greatest(F.sum("f2") * (F.sum("f2") - 1), F.lit(1.0))).alias("chance"))
    excess = F.when(F.col("most") == n, 1.0).otherwise((F.col("same") / (n * (n - 1)) - F.col("chance")) / (1 - F.col("chance")))
    return tokens.crossJoin(F.broadcast(chance)).select("token", "n", excess.alias("excess"))


def common_words(said: DataFrame) -> DataFrame:
    """(token): frequent words far from telling brands apart, at most ``COMMON_PART`` times the words of a row; `vote` has no use for them."""
    told = said.filter("brand is not null and accessory = ''")
    each = F.explode(F.array_distinct(F.split(F.concat_ws(" ", "title", "body"), r"[^\p{L}]+"))).alias("token")
    pairs = told.select("brand", each).filter(F.length("token") > 1).groupBy("brand", "token").agg(F.count("*").cast("double").alias("f2"))
    brands = told.groupBy("brand").agg(F.count("*").cast("double").alias("f2"))
    rows = F.broadcast(brands.agg(F.sum("f2").alias("rows")))
    often = F.col("n") >= F.greatest(F.lit(float(COMMON_FROM)), F.col("rows") / COMMON_PART)
    return brand_excess(pairs, brands).crossJoin(rows).filter(often & (F.col("excess") < LEAST_EXCESS / 2)).select("token")


def _words(column: str) -> Column:
    return F.split(column, r"[^\p{L}]+")


def said_by_rows(df: DataFrame) -> DataFrame:
    """What each row says: its listing's keys, shop, brand, accessory, codes and quantities by where they stand, and the texts that its words are taken from."""
    name = F.when(is_stand_in(F.col("product_name")), F.col("title")).otherwise(F.col("product_name"))
    texts = ("source_domain", "product_id", "product_url", "source_url", "brand", "vendor", "sku")
    rows = df.select("row_id", *texts, name.alias("name"), F.coalesce("description", F.lit("")).alias("body"), F.coalesce("specifications", F.lit("")).alias("specs"))
    rows = rows.select(
        "row_id",
        listing_keys().alias("keys"),
        shop_key(F.col("source_domain")).alias("shop"),
        F.coalesce(brand_key(F.col("brand")), brand_key(F.col("vendor"))).alias("brand"),
        plain_key(F.coalesce("name", F.lit(""))).alias("name"),
        plain_key(F.col("body")).alias("body"),
        F.translate(plain_key(F.col("specs")), '"\\', "; ").alias("specs"),
        F.coalesce("sku", F.lit("")).alias("sku"),
    )
    rows = rows.withColumns({"texts": F.concat_ws(" ; ", "body", "specs"), "kind": kind_of(F.col("keys"), F.col("row_id"))})
    rows = rows.withColumns({"name_counted": spell_counts(F.col("name")), "texts_counted": spell_counts(F.col("texts"))})
    # Names behind a key of the text count as standing first.
    keyed = F.regexp_extract_all("body", F.lit(r"(?:line|series|range) ?[:=-] ?(\p{L}{2,})"), F.lit(1))
    return rows.select(
        "row_id", "shop", "keys", "kind", "brand",
        accessory_of(F.col("name")).alias("accessory"),
        article_codes(F.col("name")).alias("name_codes"),
        article_codes(F.col("texts")).alias("body_codes"),
        sku_codes(F.col("sku")).alias("sku_codes"),
        quantities(F.col("name_counted")).alias("name_quantities"),
        quantities(F.col("texts_counted")).alias("body_quantities"),
        F.regexp_replace("name", _CODE, " ").alias("title"),
        F.array_join(keyed, " ").alias("keyed"),
        "body",
    )


def listing_tokens(said: DataFrame, kinds: DataFrame) -> DataFrame:
    """(listing, kind, token, pos, weight, told): the tokens of each listing with their first position, over all its captures.

    Kinds are brand, accessory, quantity, code and word; ``told`` says that a text holds the token.
    """
    common = materialize(common_words(said))

    # Explosions of plain arrays stay in generated code; lambdas that build rows don't.
    heads = said.select("row_id", "kind", F.posexplode(F.array("brand", "accessory")).alias("at", "token")).filter("token <> ''")
    heads = heads.select("row_id", "kind", F.when(F.col("at") == 0, "brand").otherwise("accessory").alias("sort"), "token", F.lit(0.0).alias("pos"), F.lit(1.0).alias("weight"), F.lit(True).alias("told"))
    measured = said.select("row_id", "kind", F.size("name_quantities").alias("first"), F.concat("name_quantities", "body_quantities").alias("each"))
    measured = base_values(measured.select("row_id", "kind", "first", F.posexplode("each").alias("at", "written")))
    weight = F.when(F.col("at") < F.col("first"), 100.0).otherwise(1.0)
    measured = measured.select("row_id", "kind", F.lit("quantity").alias("sort"), "token", F.lit(0.0).alias("pos"), weight.alias("weight"), F.lit(True).alias("told"))
    ends = (F.size("name_codes").alias("first"), (F.size("name_codes") + F.size("body_codes")).alias("second"))
    coded = said.select("row_id", "kind", *ends, F.concat("name_codes", "body_codes", "sku_codes").alias("each"))
    coded = coded.select("row_id", "kind", "first", "second", F.posexplode("each").alias("at", "token"))
    pos = F.when(F.col("at") < F.col("first"), F.col("at")).when(F.col("at") < F.col("second"), F.col("at") - F.col("first") + BEHIND_TITLE).otherwise(BEHIND_TITLE // 2)
    coded = coded.select("row_id", "kind", F.lit("code").alias("sort"), "token", pos.cast("double").alias("pos"), F.lit(1.0).alias("weight"), (F.col("at") < F.col("second")).alias("told"))
    titled = said.select("row_id", "kind", _words("title").alias("title"), _words("keyed").alias("keyed"), _words("body").alias("body"))
    titled = titled.select("row_id", "kind", F.size("title").alias("in_title"), F.concat("title", "keyed", "body").alias("words"))
    words = titled.select("row_id", "kind", "in_title", F.posexplode("words").alias("at", "token")).filter(F.length("token") > 1)
    words = words.join(F.broadcast(common), "token", "left_anti")
    pos = F.when(F.col("at") < F.col("in_title"), F.col("at")).otherwise(BEHIND_TITLE + F.col("at") - F.col("in_title")).cast("double")
    words = words.select("row_id", "kind", F.lit("word").alias("sort"), "token", pos.alias("pos"), F.lit(1.0).alias("weight"), F.lit(True).alias("told"))
    placed = with_listing(reduce(DataFrame.unionByName, (heads, measured, coded), words), kinds)
    return placed.groupBy("listing", F.col("sort").alias("kind"), "token").agg(F.min("pos").alias("pos"), F.sum("weight").alias("weight"), F.max("told").alias("told"))


def listing_heads(tokens: DataFrame) -> DataFrame:
    """(listing, brand, accessory, quantity): by majority of the captures; a listing that names no brand takes a word of its titles that is one elsewhere."""

    def most(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.struct((-F.col("weight")).alias("w"), F.col("token").alias("v"))))["v"].alias(kind)

    heads = materialize(tokens.filter("kind in ('brand', 'accessory', 'quantity')").groupBy("listing").agg(most("brand"), most("accessory"), most("quantity")))
    brands = heads.select(F.col("brand").alias("token")).filter("token is not null").distinct()
    named = tokens.filter((F.col("kind") == "word") & (F.col("pos") < BEHIND_TITLE))
    guess = named.join(heads.filter("brand is null").select("listing"), "listing", "left_semi").join(brands, "token", "left_semi")
    guess = guess.groupBy("listing").agg(F.min(F.struct((-F.col("weight")).alias("w"), "token"))["token"].alias("guess"))
    return heads.join(guess, "listing", "left").withColumn("brand", F.coalesce("brand", "guess")).drop("guess").filter("brand is not null")


def best_tokens(tokens: DataFrame, heads: DataFrame) -> DataFrame:
    """(listing, word, code and their positions): the tokens of the best combinations of two with the brand.

    Candidates are tokens that tell brands apart: that two listings with the token are of one brand must exceed what the mix of
    brands gives by chance. Tokens of one brand have an excess of 1, names that two brands use about a half, and the words of a trade
    about 0; a few rows of other brands change it little. The score is length² / (1 + position) · log(frequency), by the excess and by the part
    of the token's listings that are of the brand; the position is the mean of the listing's own and of all with the pair.
    """
    said = tokens.filter("kind in ('word', 'code')").join(heads.select("listing", "brand", "accessory"), "listing").filter((F.col("token") != F.col("brand")) & ~F.col("token").isin(*_COMPANY_WORDS))
    # Counts in doubles, whose products can't overflow. An accessory repeats the tokens of another item.
    said = materialize(said.drop("weight"))
    own = F.col("accessory").isNull()
    pairs = said.filter(own).groupBy("brand", "kind", "token").agg(F.count("*").cast("double").alias("f2"), F.avg("pos").alias("p2"), F.max("told").alias("told"))
    pairs = materialize(pairs.filter("told").drop("told"))
    brands = heads.filter("accessory is null").groupBy("brand").agg(F.count("*").cast("double").alias("f2"))
    telling = brand_excess(pairs, brands).filter(F.col("excess") >= LEAST_EXCESS)
    # What a single listing says groups nothing, but a code in its title tells it from others.
    weighed = pairs.filter(f"f2 > 1 or kind = 'code' and p2 < {BEHIND_TITLE}").join(telling, "token").select("brand", "kind", "token", "f2", "p2", (F.col("excess") * F.col("f2") / F.col("n")).alias("weight"))
    scored = join_hot(said, weighed, ["brand", "kind", "token"])
    score = F.col("weight") * 4.0 / (1.0 + (F.col("p2") + F.col("pos")) / 2) * F.log("f2")

    def best(kind: str) -> Column:
        # Titles vary where a word stands: the token itself breaks near ties between combinations of one listing.
        ranked = F.struct((-F.round(score, 6)).alias("s"), "token", F.round("p2", 3).alias("pos"))
        return F.min(F.when(F.col("kind") == kind, ranked)).alias(kind)

    return scored.groupBy("listing").agg(best("word"), best("code")).select(
        "listing", F.col("word")["token"].alias("word"), F.col("word")["pos"].alias("word_pos"), F.col("code")["token"].alias("code"), F.col("code")["pos"].alias("code_pos")
    )


def combinations(listings: DataFrame) -> DataFrame:
    """(listing, combo, size, pos, code, quantity): all combinations of a listing's brand with its word, code and quantity that hold one of the first two.

    Two hashes of 64 bits stand for a combination; code and quantity are hashes for comparison.
    """
    brand = F.concat_ws("|", "brand", F.coalesce("accessory", F.lit("")))
    forms = []
    for held in (("word",), ("code",), ("word", "code"), ("word", "quantity"), ("code", "quantity"), ("word", "code", "quantity")):
        there = F.lit(True)
        for h in held:
            there = there & F.col(h).isNotNull()
        name = F.concat_ws("|", brand, *(F.concat(F.lit(h[0] + ":"), F.col(h)) for h in held))
        places = [F.col(f"{h}_pos") for h in held if h != "quantity"]
        pos = sum(places[1:], places[0]) / len(places)
        combo = F.struct(F.xxhash64(name).alias("a"), F.xxhash64(F.lit(7), name).alias("b"))
        forms.append(F.when(there, F.struct(combo.alias("combo"), F.lit(1.0 + len(held)).alias("size"), pos.alias("pos"))))
    hashed = (F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) for c in ("code", "quantity"))
    return listings.select("listing", *hashed, F.inline(F.array_compact(F.array(*forms))))


def elected_clusters(listings: DataFrame) -> DataFrame:
    """(listing, cluster) from listings with their brand, accessory, word, code and quantity: vote, verification, merging."""
    combos = materialize(combinations(listings))
    counted = combos.groupBy("combo").agg(
        F.count("*").alias("n"), F.avg("pos").alias("p"), *(f(c).alias(f"{c}_{f.__name__}") for c in ("code", "quantity") for f in (F.min, F.max))
    )
    # Verification: a combination under which two codes or two quantities stand is more than one item.
    one_code = F.coalesce(F.col("code_min") == F.col("code_max"), F.lit(True))
    one_quantity = F.coalesce(F.col("quantity_min") == F.col("quantity_max"), F.lit(True))
    clear = counted.filter((F.col("n") > 1) & one_code & one_quantity).select("combo", "n", "p")
    score = F.col("size") * F.col("size") / (1.0 + F.col("p")) * F.log(F.col("n").cast("double"))
    held = join_hot(combos.select("listing", "combo", "size"), clear, "combo")
    votes = held.groupBy("listing").agg(
        F.min(F.struct((-F.round(score, 6)).alias("s"), "combo"))["combo"].alias("best"), F.sort_array(F.collect_list("combo")).alias("holds")
    )
    votes = materialize(votes)
    # Listings that hold the same combinations are one item to the search; of these only elected ones link.
    kinds = votes.groupBy("holds").agg(F.min("listing").alias("kind"))
    elected = votes.select("best").distinct()
    links = kinds.select("kind", F.explode("holds").alias("combo")).join(elected, F.col("combo") == F.col("best"), "left_semi")
    merged = connected_components(links, "kind", "combo").select(F.col("item").alias("kind"), F.col("component").alias("cluster"))
    return join_hot(votes.select("listing", "holds"), kinds.join(merged, "kind").drop("kind"), "holds").select("listing", "cluster")


def match_listings(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind to listing, listing to cluster)."""
    kinds = materialize(listing_kinds(said.select("row_id", "keys")))
    tokens = materialize(listing_tokens(said, kinds))
    heads = materialize(listing_heads(tokens))
    return kinds, materialize(elected_clusters(heads.join(best_tokens(tokens, heads), "listing")))


def same_item_rows(df: DataFrame) -> DataFrame:
    """(row_id, cluster, shop, size) of all rows whose listing is in a cluster of several shops; ``size``: the rows of the cluster."""
    said = materialize(said_by_rows(df))
    kinds, clusters = match_listings(said)
    rows = said.select("row_id", "kind", "shop")
    rows = materialize(with_listing(rows, kinds).join(clusters, "listing").select("row_id", "cluster", "shop").distinct())
    several = rows.groupBy("cluster").agg(F.min("shop").alias("low"), F.max("shop").alias("high"), F.count("*").alias("size")).filter("low <> high")
    return join_hot(rows, several.select("cluster", "size"), "cluster")


def same_item_pairs(df: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: rows of different shops that describe the same item.

    A large cluster is split: each part of ``PAIRED_AT_ONCE`` rows meets all rows of the cluster in a task of its own.
    """
    rows = materialize(same_item_rows(df).withColumn("parts", F.ceil(F.col("size") / PAIRED_AT_ONCE).cast("int")))
    part = F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int")
    a = rows.select("cluster", part.alias("part"), F.col("row_id").alias("row_id_a"), F.col("shop").alias("shop_a"))
    b = rows.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("row_id").alias("row_id_b"), F.col("shop").alias("shop_b"))
    return a.join(b, ["cluster", "part"]).filter("row_id_a < row_id_b and shop_a <> shop_b").select("row_id_a", "row_id_b")


def same_item_classes(df: DataFrame) -> DataFrame:
    """(row_id, class_id, links): one row per row of a class; ``class_id`` is its least row, ``links`` the rows of other shops in it."""
    rows = materialize(same_item_rows(df))
    least = rows.groupBy("cluster").agg(F.min("row_id").alias("class_id"))
    own = rows.groupBy("cluster", "shop").agg(F.count("*").alias("own"))
    named = join_hot(join_hot(rows, least, "cluster"), own, ["cluster", "shop"])
    return named.select("row_id", "class_id", (F.col("size") - F.col("own")).alias("links"))

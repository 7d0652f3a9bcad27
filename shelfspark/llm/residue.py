"""Template residue, filler, error pages and demands for scripts in place of product text.

Messages repeat over records that have nothing else in common, and say nothing about their record. Values are folded to plain
lower-case tokens with numbers masked, and message templates are mined from them with a prefix tree of fixed depth: the path of a
value is its number of tokens and its first ``DEPTH`` tokens. In each leaf clusters form around its commonest keys by the
positions that agree; positions where the values of a cluster differ are the template's slots. Each template is classified once,
from its fixed words, its slots, the spread of its values over shops and brands, and whether they name the brand of their
record; the verdict is propagated to the values by joins. No value has a verdict of its own but for slots.

Values without any word that a verdict asks for can't get one whatever their template is; they don't enter the tree.

Unfilled placeholders are searched in each value by itself, since they also stand amid real text.

Null, blank and bare stand-ins for missing values are no cases. Texts are searched whole. Ties between keys are broken by the
key. Repeated rows share their template. Without columns of shop and brand no template counts as spread, nor as a record's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.listing import shop_key
from shelfspark.functions.plain import fold_lookalikes, is_stand_in, squeeze, strip_accents
from shelfspark.operators.skew import join_hot
from shelfspark.session import materialize

#: Tokens that the path of the prefix tree holds besides the length.
DEPTH = 3
#: Passes over a leaf, each with the commonest key left as the centre of a cluster; what stays is a template by itself.
PASSES = 3
#: Equal positions that a key and the centre of its cluster share at least.
LIKE = 0.6
#: Least part of a template's fixed words that messages are made of: for templates of several shops and brands, and for others.
COVER_SPREAD, COVER_ALONE = 0.6, 0.8
# Names of fields as templates write them.
_FIELD_WORDS = (
    "name|title|product|item|variant|sku|vendor|brand|price|category|description|desc|short_desc|short|shop|store|size|color|colour|image|url|"
    "handle|collection|tag|tags|type|id|value|text|customer|user|first_name|last_name|email|date|currency|quantity|qty|stock|seller|option|model|number|code"
)
_FIELD = rf"(?:{_FIELD_WORDS})(?:[._\- ](?:{_FIELD_WORDS}))*"
_ANY = r"[\p{L}_][\p{L}\p{N}_.\-| ]*"
# Forms of an unfilled slot. Marks that real text uses too need the name of a field between them.
SLOT_PATTERNS = (
    rf"\{{\{{\s*{_ANY}\s*\}}\}}",
    r"\{%[^{}]+%\}",
    r"<%[^<>]+%>",
    rf"[$#]\{{\s*{_ANY}\}}",
    rf"\[\[\[?\s*{_ANY}\]\]\]?",
    rf"@@\s*{_ANY}@@",
    rf"<<\s*{_ANY}>>",
    r"<insert\b[^<>]*>",
    rf"__{_FIELD}__",
    rf"\{{\s*{_FIELD}\s*\}}",
    rf"\[\s*{_FIELD}\s*\]",
    rf"%\(?{_FIELD}\)?s?%",
    rf"%\({_FIELD}\)s",
    rf"\${_FIELD}\$",
    rf"(?<![\p{{L}}\p{{N}}])(?:tmpl|tpl|var):{_FIELD}",
)
# The words that messages are made of, by what they stand for, in the languages of the shops.
SCRIPT = frozenset("javascript js script scripts scripting noscript جاوا اسکرپٹ جاوااسکرپٹ".split())
DEMAND = frozenset(
    "enable enabled enabling activate activated allow allowed require requires required need needs needed must turn turned switch switched support supported disable disabled "
    "without blocked aktivieren aktiviert einschalten activa activar active activer activez habilite habilitar فعال".split()
)
SUBJECT = frozenset(
    "page pages product products item items site website shop store server service gateway request requests requested url link address catalogue catalog app application browser session "
    "connection database access http https content seite seiten produkt artikel página pagina producto artículo produit article صفحہ".split()
)
FAULT = frozenset(
    "error errors denied forbidden unauthorized blocked expired failed failure refused timeout unavailable wrong oops exception traceback fatal uncaught introuvable fehler".split()
)
NEGATION = frozenset(
    "not no cannot can't couldn't isn't doesn't don't wasn't won't aren't longer unable nicht kein keine nunca ne pas non نہیں".split()
)
STATE = frozenset(
    "found find available exist exists load loaded displayed shown show work works reach reached gefunden verfügbar encontrada encontrado disponible trouvée trouvee trouvé ملا".split()
)
STATUS = frozenset("gateway bad internal server service unavailable requests many nginx apache slow".split())
ADDRESSED = frozenset("you something".split())
CHECK = frozenset("checking verify verifying verified human robot captcha moment wait".split())
LATIN_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip "
    "ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
MASHED = frozenset("asdf asdfgh qwerty qwertz foo bar baz blah bla xxx tbc tbd todo abc test testing sample dummy placeholder example lorem".split())
STAND_FOR = frozenset("dummy sample test testing placeholder example default pending todo testartikel lorem".split())
FILL_IN = frozenset("insert enter write add put type".split())
FIELD_NAMES = frozenset("description descriptions title name text copy content details product item".split())
NULLISH = frozenset("undefined null nan object".split())
# Words that say nothing by themselves, and what servers and shops say around a message.
AROUND = frozenset(
    "the a an too this that these those you your our we we're you're i it its it's is are was were be been being has have had to for of on at by and or but if before after while with as from up out any more "
    "some few about all please sorry kindly then again later try reload continue view run may can could will properly correctly back return home go going looking completing action below has your ip logged ticket "
    "reference occurred went processing slow down means web in into off just soon coming follow here goes replace launch publish bestellen order new few cookies ad blocker shop's most recent call last keyerror "
    "method nil undefined liquid loading der die das ein eine wurde ist sind sie um zu fortzufahren bitte dieses dieser diese wird el la los las en tu su para continuar por favor navegador es le les de du des votre "
    "veuillez s'il vous plaît pour براہ کرم کریں ہے this isn't cannot hr center br html body h1 head p div see web erp brand size cm price colour color slow something line".split()
)
# What a template must hold one of, so that any of the verdicts can hold; values without one never move.
ANCHORS = SCRIPT | FAULT | (STATE - {"work", "works", "show", "find"}) | {"find", "work", "works", "show", "requests"} | CHECK | (LATIN_FILLER - {"in", "non", "do", "ex", "id", "et"}) | MASHED | STAND_FOR | (NULLISH - {"object"}) | {"object", "here", "follow", "soon", "copy", "gateway", "internal"}
_MESSAGE_WORDS = SCRIPT | DEMAND | SUBJECT | FAULT | NEGATION | STATE | STATUS | CHECK | STAND_FOR | FILL_IN | FIELD_NAMES | NULLISH | AROUND
_NUMBER = "<*>"


def message_key(text: Column) -> Column:
    """Lower-case text of plain characters without tags; words with a digit masked."""
    key = F.lower(squeeze(fold_lookalikes(text)))
    key = F.translate(key, "’", "'")
    key = F.when(F.contains(key, F.lit("<")), F.regexp_replace(key, r"</?[a-z][a-z0-9]*(?: [^<>]*)?/?>", " ")).otherwise(key)
    return F.when(key.rlike(r"\d"), F.regexp_replace(key, r"[\p{L}\p{N}_#./:]*\d[\p{L}\p{N}_./:]*", _NUMBER)).otherwise(key)


def message_tokens(key: Column) -> Column:
    return F.filter(F.split(key, r"[^\p{L}\p{M}<*>']+"), lambda t: t != "")


def has_slot(text: Column) -> Column:
    """The text holds an unfilled placeholder."""
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in SLOT_PATTERNS)
    marks = text.rlike(r"[{}%<>\[\]@$#]|__|(?i:tmpl|tpl|var):")
    return F.coalesce(marks & text.rlike(pattern), F.lit(False))


def classify_template(tokens: Column, spread: Column, own: Column) -> Column:
    """``script``, ``error`` or ``filler`` for a template, else null.

    ``tokens`` are its fixed words, with ``<*>`` for slots; ``spread``: values of several shops and brands have it; ``own``: all
    its values name the brand of their own record. A verdict needs the words of a message, and that little else is fixed.
    """

    def count(words: frozenset[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*sorted(words))))

    fixed = F.size(F.filter(tokens, lambda t: t != _NUMBER))
    slots = F.size(tokens) - fixed
    covered = count(_MESSAGE_WORDS)
    cover = covered / F.greatest(fixed, F.lit(1))
    enough = (fixed > 0) & ~own & (cover >= F.when(spread, COVER_SPREAD).otherwise(COVER_ALONE))
    script = (count(SCRIPT) > 0) & ((count(DEMAND) > 0) | (F.array_contains(tokens, "noscript")))
    fault = count(FAULT)
    missing = (count(NEGATION) > 0) & (count(STATE) > 0)
    about = (count(SUBJECT | ADDRESSED) > 0) | (slots > 0) | (fixed <= 4)
    status = (count(STATUS) >= 2) & (count(STATUS | AROUND | SUBJECT) == fixed)
    error = ((fault > 0) | missing | status) & about | (count(CHECK) > 0) & (count(SUBJECT | CHECK) >= 2) | (count(frozenset(("just", "moment"))) == 2)
    latin = (count(LATIN_FILLER) >= 3) & (count(LATIN_FILLER) >= 0.9 * fixed)
    mashed = (count(MASHED) >= 2) & (count(MASHED) == fixed)
    nullish = (count(NULLISH) >= 2) & (count(NULLISH) * 3 >= fixed)
    fill_in = (count(FIELD_NAMES) > 0) & ((count(STAND_FOR) > 0) | F.array_contains(tokens, "here") | (F.array_contains(tokens, "follow") & (fixed <= 4)))
    said = (count(STAND_FOR) > 0) & (fixed >= 2) | F.array_contains(tokens, "soon") & (fixed <= 5) | (F.array_contains(tokens, "new") & F.array_contains(tokens, "copy") & F.array_contains(tokens, "product"))
    return (
        F.when(~own & (latin | mashed), "filler")
        .when(enough & script, "script")
        .when(enough & (nullish | fill_in | said), "filler")
        .when(enough & error, "error")
    )


def _path(tokens: Column) -> Column:
    return F.concat_ws(" ", F.size(tokens).cast("string"), F.slice(tokens, 1, DEPTH))


def _differences(a: Column, b: Column) -> Column:
    """Positions from 0 at which two lists of tokens of one length differ."""
    each = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, i: F.when(p["a"] != p["b"], i))
    return F.array_compact(each)


def mine_templates(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, centre) and templates (centre, template, spread, own) from (key, rows, shop and brand: low and high, own).

    ``key`` holds tokens parted by spaces and is unique. Statistics combine before each shuffle, and a leaf that holds a great part of all keys
    is split over tasks.
    """
    tokens = F.split("key", " ")
    placed = materialize(keys.select("*", _path(tokens).alias("leaf"), F.lit(None).cast("string").alias("centre")))
    for _ in range(PASSES):
        rest = placed.filter("centre is null")
        best = F.max(F.struct("rows", "key"))["key"]
        centres = rest.groupBy("leaf").agg(best.alias("found"), F.count("*").alias("n")).filter("n > 1").drop("n")
        near = join_hot(placed, centres, "leaf", "left")
        apart = F.size(_differences(tokens, F.split("found", " ")))
        close = F.col("centre").isNull() & (apart <= (1 - LIKE) * F.size(tokens))
        placed = materialize(near.withColumn("centre", F.when(close, F.col("found")).otherwise(F.col("centre"))).drop("found"))
    placed = placed.withColumn("centre", F.coalesce("centre", "key"))
    apart = placed.withColumn("slot", F.explode_outer(_differences(tokens, F.split("centre", " "))))
    several = (F.min("low_shop") < F.max("high_shop")) & (F.min("low_brand") < F.max("high_brand"))
    templates = apart.groupBy("centre").agg(
        F.collect_set("slot").alias("slots"), F.coalesce(several, F.lit(False)).alias("spread"), F.min("own").alias("own")
    )
    fixed = F.transform(F.split("centre", " "), lambda t, i: F.when(F.array_contains(F.col("slots"), i), _NUMBER).otherwise(t))
    return placed.select("key", "centre"), templates.select("centre", fixed.alias("template"), "spread", "own")


def message_candidates(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(_id, field_name, slot, key, shop, brand, own) of the values that hold a slot, or a word that a verdict asks for."""

    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    brand = F.when(is_stand_in(column("brand")), column("vendor")).otherwise(column("brand"))
    letters = F.regexp_replace(strip_accents(F.lower(fold_lookalikes(brand))), r"[^\p{L}]+", "")
    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("_text")) for c in columns))
    values = df.select(F.col(id_col).alias("_id"), shop_key(column("source_domain")).alias("shop"), letters.alias("brand"), F.inline(fields)).filter(~is_stand_in(F.col("_text")))
    values = values.withColumn("slot", has_slot(fold_lookalikes(F.col("_text"))))
    values = values.withColumn("tokens", F.when(~F.col("slot"), message_tokens(message_key(F.col("_text")))))
    held = F.col("slot") | F.exists("tokens", lambda t: t.isin(*sorted(ANCHORS)))
    found = values.filter(held)
    said = F.regexp_replace(strip_accents(F.array_join("tokens", "")), r"[^\p{L}]+", "")
    own = F.coalesce((F.length("brand") >= 4) & F.contains(said, F.col("brand")), F.lit(False))
    return found.select("_id", "field_name", "slot", F.array_join("tokens", " ").alias("key"), "shop", "brand", own.alias("own"))


def residue(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, field_name, verdict): the values that are no product text (``slot``, ``script``, ``error`` or ``filler``)."""
    values = materialize(message_candidates(df, id_col, columns))
    keys = values.filter("not slot").groupBy("key").agg(
        F.count("*").alias("rows"), F.min("shop").alias("low_shop"), F.max("shop").alias("high_shop"), F.min("brand").alias("low_brand"), F.max("brand").alias("high_brand"), F.min("own").alias("own")
    )
    members, templates = mine_templates(keys)
    judged = templates.select("centre", classify_template(F.col("template"), F.col("spread"), F.col("own")).alias("verdict")).filter("verdict is not null")
    verdicts = join_hot(members, judged, "centre").select("key", "verdict")
    plain = join_hot(values.filter("not slot"), verdicts, "key")
    whole = values.filter("slot").select("_id", "field_name", F.lit("slot").alias("verdict"))
    return plain.select("_id", "field_name", "verdict").unionByName(whole).withColumnRenamed("_id", id_col)

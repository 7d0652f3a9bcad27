"""Several values packed in one text: dictionary-guided segmentation.

A dictionary of whole values is counted over all rows from the encodings that leave no doubt (JSON arrays and doubled
bars). A multi-pattern automaton finds known whole values in each text, and dynamic programming over the possible cuts
picks the best cover: cheap for known values, dearer for unknown ones, so that a delimiter inside a legitimate value is
protected. Quoted spans, escaped delimiters and addresses are atoms that no cut may enter.

Values that make up at least ``1 / DICTIONARY_BOUND`` of all counted values, hence at most ``DICTIONARY_BOUND`` whatever the size of
the corpus, go to the workers. Rarer values that hold a mark meet the texts by an equi-join with the spans between their cuts,
so that they are protected as well.

Null, blank, bare stand-ins and texts of nothing but marks have no rows. Repeats stay. A text may be of any length.
"""

from __future__ import annotations

import ast
import json
import re
import uuid
from collections.abc import Callable, Collection, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.plain import is_stand_in
from shelfspark.operators.skew import join_hot
from shelfspark.session import materialize

#: Most entries of the dictionary that goes to the workers.
DICTIONARY_BOUND = 20_000
#: What a known value below the bound costs in a cover: as much as the least frequent one above it.
RARE_COST = 0.5
# Marks that may part values. A slash parts only between spaces, white space only before an address.
_ESCAPED = re.compile(r"\\([\\|,;/\"'·•、｜\t ])")
_MARK = re.compile(r"\|+|[,;、｜·•\t\n\r]|(?<=\s)/(?=\s)")
#: The same marks for Spark.
MARKS = r"[|,;、｜·•\t\n\r]|\s/\s"
_ADDRESS = re.compile(r"(?:https?:)?//[^\s\"'<>|]+", re.IGNORECASE)
_ADDRESS_START = re.compile(r"(?:https?:)?//", re.IGNORECASE)
_TRAILING = ",;|/、｜·•"
_CLOSERS = {'"': '"', "'": "'", "“": "”", "«": "»"}


def counted_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field_name, value, n) of whole values, from JSON arrays and texts parted by doubled bars, over all rows."""
    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("text")) for c in columns))
    texts = df.select(F.inline(fields)).filter(F.col("text").rlike(r"^\s*\[\s*\"|\|\|"))
    values = F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>")).otherwise(F.split("text", r"\|\|"))
    return (
        texts.select("field_name", F.explode(values).alias("value"))
        .select("field_name", F.trim("value").alias("value"))
        .filter((F.col("value") != "") & ~F.col("value").rlike(r"^(?:https?:)?//"))
        .groupBy("field_name", "value")
        .agg(F.count("*").alias("n"))
    )


def dictionary(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, dict[str, int]], DataFrame]:
    """The common values with their counts by field, at most ``DICTIONARY_BOUND`` a field, and the table (field_name, value) of the rarer ones that hold a mark."""
    counted = materialize(counted_values(df, columns))
    totals = {r["field_name"]: r["n"] for r in counted.groupBy("field_name").agg(F.sum("n").alias("n")).collect()}
    share = F.lit(0.0)
    for field, total in totals.items():
        share = F.when(F.col("field_name") == field, F.col("n") / F.lit(float(total))).otherwise(share)
    out: dict[str, dict[str, int]] = {c: {} for c in columns}
    for row in counted.filter(share * DICTIONARY_BOUND >= 1.0).collect():  # at most DICTIONARY_BOUND values a field
        out[row["field_name"]][row["value"]] = row["n"]
    return out, counted.filter((share * DICTIONARY_BOUND < 1.0) & F.col("value").rlike(MARKS)).select("field_name", "value")


class Segmenter:
    """Splits the texts of one field. ``known`` gives whole values with their counts."""

    def __init__(self, known: dict[str, int]) -> None:
        import ahocorasick

        self.cost = {}
        top = max(known.values(), default=1)
        self.automaton = ahocorasick.Automaton()
        for value, n in known.items():
            # A known value costs less than an unknown one; of two covers the one with fewer and commoner values wins.
            self.cost[value] = 0.4 + 0.1 * (1 - n / top)
            self.automaton.add_word(value, value)
        self.ready = bool(known)
        if self.ready:
            self.automaton.make_automaton()

    def split(self, text: str | None, rare: Collection[str] = ()) -> list[str]:
        """The values; ``rare`` holds further known values of this text."""
        if text is None:
            return []
        text = text.strip()
        if text[:1] == "[" and text[-1:] == "]":
            listed = self._listed(text)
            if listed is not None:
                return listed
        return self._cover(*self._atoms(self._unwrap(text)), frozenset(rare))

    def spans(self, text: str | None, most: int) -> list[str]:
        """What stands between cuts of a text with one to ``most`` cuts inside, without repeats."""
        if text is None or (text := text.strip())[:1] == "[" and text[-1:] == "]" and self._listed(text) is not None:
            return []
        _, cuts, clean, _ = self._atoms(self._unwrap(text))
        begins, ends = [0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(clean)]
        found = (clean[begins[i] : ends[j]].strip() for i in range(len(begins)) for j in range(i + 1, min(i + most + 1, len(ends))))
        return list(dict.fromkeys(s for s in found if s))

    @staticmethod
    def _unwrap(text: str) -> str:
        if text[:1] in ("[", "{", "(") and text[-1:] == {"[": "]", "{": "}", "(": ")"}[text[:1]]:
            text = text[1:-1].strip()
        return text

    @staticmethod
    def _listed(text: str) -> list[str] | None:
        try:
            items = json.loads(text)
        except ValueError:
            try:
                items = ast.literal_eval(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return None
        if not isinstance(items, list):
            return None
        return [x for x in (str(i).strip() for i in items if i is not None and not isinstance(i, (list, dict))) if x]

    @staticmethod
    def _atoms(text: str) -> tuple[list[str], list[tuple[int, int]], str, bytearray]:
        """Cleaned text, with the spans between cuts; ``shut`` marks characters that came quoted, escaped or in an address."""
        out: list[str] = []
        shut = bytearray()
        cuts: list[tuple[int, int]] = []
        pos, start, size = 0, True, len(text)
        while pos < size:
            ch = text[pos]
            if ch == "\\" and (m := _ESCAPED.match(text, pos)):
                out.append(m.group(1))
                shut.append(1)
                pos, start = m.end(), False
                continue
            if start and ch in _CLOSERS:
                close, at, span = _CLOSERS[ch], pos + 1, []
                while at < size:
                    if text[at] == close:
                        if text[at + 1 : at + 2] == close and close == ch:
                            span.append(close)
                            at += 2
                            continue
                        if ch != "'" or at + 1 >= size or not text[at + 1].isalnum():
                            break
                    elif text[at] == "\\" and at + 1 < size and text[at + 1] in "\\" + close:
                        span.append(text[at + 1])
                        at += 2
                        continue
                    span.append(text[at])
                    at += 1
                rest = text[at + 1 :].lstrip(" ")
                if at < size and (not rest or _MARK.match(rest) or rest[:1] == "/" or _ADDRESS_START.match(rest)):
                    out += span
                    shut += b"\x01" * len(span)
                    pos, start = at + 1, False
                    continue
            if start and ch in "h/H" and (m := _ADDRESS.match(text, pos)):
                address = m.group(0)
                # A mark belongs to the address unless another address begins behind it.
                for cut in re.finditer(r"[,;]+(?=(?:https?:)?//)", address, re.IGNORECASE):
                    address = address[: cut.start()]
                    break
                address = address.rstrip(_TRAILING) or address
                out += address
                shut += b"\x01" * len(address)
                pos += len(address)
                start = False
                gap = re.compile(r"\s+").match(text, pos)
                if gap and _ADDRESS_START.match(text, gap.end()):
                    cuts.append((len(out), len(out)))
                    pos, start = gap.end(), True
                continue
            if m := _MARK.match(text, pos):
                begin = len(out)
                out += m.group(0)
                shut += b"\x00" * (m.end() - m.start())
                cuts.append((begin, len(out)))
                pos, start = m.end(), True
                continue
            out.append(ch)
            shut.append(0)
            start = start and ch.isspace()
            pos += 1
        return out, cuts, "".join(out), shut

    def _cover(self, out: list[str], cuts: list[tuple[int, int]], clean: str, shut: bytearray, rare: frozenset[str]) -> list[str]:
        if not cuts:
            value = clean.strip()
            return [value] if value else []
        begins = [0, *(c[1] for c in cuts)]
        ends = [*(c[0] for c in cuts), len(clean)]
        n = len(begins)
        # Known whole values that start and end at possible cuts and hold a mark.
        inside: dict[int, list[tuple[int, str]]] = {}
        if self.ready:
            first = {b + len(clean[b:e]) - len(clean[b:e].lstrip()): i for i, (b, e) in enumerate(zip(begins, ends, strict=True))}
            last = {b + len(clean[b:e].rstrip()): i for i, (b, e) in enumerate(zip(begins, ends, strict=True))}
            for end, value in self.automaton.iter(clean):
                i, j = first.get(end + 1 - len(value)), last.get(end + 1)
                if i is not None and j is not None and j > i:
                    inside.setdefault(i, []).append((j, value))
        longest = max((len(v) for v in rare), default=0)
        for i in range(n if rare else 0):
            for j in range(i + 1, n):
                if ends[j] - begins[i] > longest + 2 * (j - i) + 40 and len(clean[begins[i] : ends[j]].strip()) > longest:
                    break
                if (value := clean[begins[i] : ends[j]].strip()) in rare:
                    inside.setdefault(i, []).append((j, value))
        best: list[tuple[float, int, str]] = [(0.0, -1, "")] * (n + 1)
        for i in range(n - 1, -1, -1):
            value = clean[begins[i] : ends[i]].strip()
            cost = self.cost.get(value, 1.0) if value else 0.0
            choice = (cost + best[i + 1][0], i + 1, value)
            for j, joined in inside.get(i, ()):
                cost = self.cost.get(joined, RARE_COST) + best[j + 1][0]
                if cost < choice[0]:
                    choice = (cost, j + 1, joined)
            best[i] = choice
        values, i = [], 0
        while i < n:
            _, i, value = best[i]
            if value:
                values.append(value)
        return values


_SEGMENTERS: dict[str, dict[str, Segmenter]] = {}


def split_values(df: DataFrame, id_col: str, columns: Sequence[str], known: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(id, field_name, item_pos, item_value): one row per packed value of each of ``columns``, positions from 0.

    ``known`` replaces the dictionary that is counted otherwise.
    """
    spark = df.sparkSession
    common, rare = dictionary(df, columns) if known is None else (known, None)
    shared = spark.sparkContext.broadcast(common)
    key = uuid.uuid4().hex

    def segmenters() -> dict[str, Segmenter]:
        if key not in _SEGMENTERS:
            # A worker keeps the segmenters of one run only.
            _SEGMENTERS.clear()
            _SEGMENTERS[key] = {f: Segmenter(k) for f, k in shared.value.items()}
        return _SEGMENTERS[key]

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_field = segmenters()
        for batch in batches:
            more = batch["rare"] if "rare" in batch else [None] * len(batch)
            batch["items"] = [by_field[f].split(t, () if r is None else r) for f, t, r in zip(batch["field_name"], batch["_text"], more, strict=True)]
            yield batch[["_id", "field_name", "items"]]

    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("_text")) for c in columns))
    texts = df.select(F.col(id_col).alias("_id"), F.inline(fields)).filter(~is_stand_in(F.col("_text")))
    marks = rare.agg(F.max(F.length(F.regexp_replace("value", MARKS, "\x00\x00")) - F.length(F.regexp_replace("value", MARKS, "\x00"))).alias("n")).first()["n"] if rare is not None else None
    if marks:
        texts = _with_rare(texts, rare, marks, segmenters)
    kind = dict(texts.dtypes)["_id"]
    split = texts.mapInPandas(segment, f"_id {kind}, field_name string, items array<string>")
    return split.select(F.col("_id").alias(id_col), "field_name", F.posexplode("items").alias("item_pos", "item_value"))


def _with_rare(texts: DataFrame, rare: DataFrame, marks: int, segmenters: Callable[[], dict[str, Segmenter]]) -> DataFrame:
    """Adds ``rare``, the known values of at most ``marks`` marks that stand between cuts of each text."""
    at = F.struct(F.xxhash64("field_name", "_text").alias("a"), F.xxhash64("_text", F.lit(7), "field_name").alias("b"))
    texts = texts.withColumn("_at", at)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_field = segmenters()
        for batch in batches:
            batch["value"] = [by_field[f].spans(t, marks) for f, t in zip(batch["field_name"], batch["_text"], strict=True)]
            yield batch[["a", "b", "field_name", "value"]]

    asked = texts.filter(F.col("_text").rlike(MARKS)).select("_at.a", "_at.b", "field_name", "_text")
    found = asked.mapInPandas(spans, "a bigint, b bigint, field_name string, value array<string>").select("a", "b", "field_name", F.explode("value").alias("value"))
    held = found.distinct().join(rare, ["field_name", "value"]).groupBy(F.struct("a", "b").alias("_at")).agg(F.collect_list("value").alias("rare"))
    return join_hot(texts, held, "_at", "left").drop("_at")


def join_values(values: Column, mark: str = "|") -> Column:
    """The way back: values packed with ``mark``, escaped where they hold it."""
    return F.concat_ws(mark, F.transform(values, lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit(mark), F.lit("\\" + mark))))

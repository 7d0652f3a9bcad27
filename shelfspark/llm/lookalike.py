"""Visually identical text with different characters: one form for each look-alike class.

Look-alike pairs of strings and code points (full-width forms, ligatures, composed and decomposed letters, odd spaces,
invisible characters, letters of other scripts drawn like Latin ones) are joined by union-find into transitive classes.
The representative of a class is its plainest member, by its frequency over all rows where several are as plain; a
multi-pattern automaton then rewrites each text greedily, longest match first.

A letter of another script stays where the word is truly written in that script: where the word has a letter without a
Latin look-alike, or stands beside such a word. Joiners stay inside emoji and between letters of joining scripts.

Null gives null, empty gives empty; texts of any length are rewritten whole. Rewriting is idempotent.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.plain import INVISIBLE, LIGATURES, LOOKALIKE_LETTERS, ODD_SPACES

_JOINERS = "‌‍‎‏؜"


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in out.values()]


def lookalike_pairs() -> Iterator[tuple[str, str]]:
    """Strings that a reader sees alike. Case, marks with an effect of their own and compatibility signs are no pairs."""
    for code in range(0xFF01, 0xFF5F):
        yield chr(code), chr(code - 0xFEE0)
    for ch in INVISIBLE:
        yield ch, ""
    for ch in ODD_SPACES:
        yield ch, " "
    yield "‐", "-"
    yield "‑", "-"
    yield from LIGATURES.items()
    yield from LOOKALIKE_LETTERS.items()
    # Composed letters and their decompositions, and code points that stand for one other code point.
    for block in ((0xC0, 0x250), (0x340, 0x342), (0x370, 0x530), (0x600, 0x700), (0x900, 0xE00), (0x1E00, 0x2000), (0x2126, 0x212C)):
        for code in range(*block):
            apart = unicodedata.normalize("NFD", chr(code))
            if apart != chr(code):
                whole = unicodedata.normalize("NFC", apart)
                yield chr(code), whole
                if whole != apart:
                    yield apart, whole
                    # The base may itself have been composed before a further mark.
                    partly = unicodedata.normalize("NFC", apart[:-1]) + apart[-1]
                    if partly != apart:
                        yield partly, whole
    # Presentation forms of Arabic letters.
    for code in (*range(0xFB50, 0xFBB2), *range(0xFE70, 0xFEFD)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and unicodedata.category(chr(code)) == "Lo":
            yield chr(code), plain


def lookalike_classes() -> list[list[str]]:
    """Transitive classes; letters of other scripts are joined with Latin ones, so that their members are alike throughout."""
    sets = UnionFind()
    for a, b in lookalike_pairs():
        sets.union(a, b)
    return sets.classes()


def _tier(member: str) -> int:
    if member.isascii():
        return 0
    return 1 if unicodedata.normalize("NFKC", member) == member and len(member) == 1 else 2


def representatives(counts: Mapping[str, int]) -> dict[str, str]:
    """Member to representative, for members that aren't their own: the plainest, then the most frequent, member."""
    out = {}
    for members in lookalike_classes():
        best = min(members, key=lambda m: (_tier(m), -counts.get(m, 0), len(m), m))
        out.update({m: best for m in members if m not in (best, "")})
    return out


def _script(ch: str) -> str:
    code = ord(ch)
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    return "latin" if code < 0x370 or 0x1E00 <= code < 0x1F00 or code >= 0x2100 else "other"


class Rewriter:
    """Rewrites texts to the representatives, greedily from the left with the longest match."""

    def __init__(self, best: Mapping[str, str]) -> None:
        import ahocorasick

        self.best = dict(best)
        self.automaton = ahocorasick.Automaton()
        for member in self.best:
            self.automaton.add_word(member, member)
        self.automaton.make_automaton()
        latin = set(LOOKALIKE_LETTERS)
        self.drawn_alike = {m for m in self.best if len(m) == 1 and m in latin and _script(m) in ("greek", "cyrillic")}

    def _true_words(self, text: str) -> list[bool]:
        """For each character, whether it is in a word truly written in Greek or Cyrillic."""
        size = len(text)
        keep = [False] * size
        words: list[tuple[int, int, str]] = []
        pos = 0
        while pos < size:
            if not (text[pos].isalpha() or unicodedata.combining(text[pos])):
                pos += 1
                continue
            begin, kinds = pos, set()
            while pos < size and (text[pos].isalpha() or unicodedata.combining(text[pos]) or text[pos] in INVISIBLE):
                ch = text[pos]
                if ch.isalpha():
                    script = _script(ch)
                    if script in ("greek", "cyrillic"):
                        # A marked letter isn't the bare Latin one.
                        marked = pos + 1 < size and unicodedata.combining(text[pos + 1])
                        kinds.add("alike" if ch in self.drawn_alike and not marked else "true")
                    else:
                        kinds.add("latin")
                pos += 1
            kind = "latin" if "latin" in kinds else "true" if "true" in kinds else "alike" if kinds else "none"
            words.append((begin, pos, kind))
        solid = [w[2] for w in words]
        for i, (begin, end, kind) in enumerate(words):
            beside = solid[max(0, i - 1) : i] + solid[i + 1 : i + 2]
            if kind == "true" or kind == "alike" and ("true" in beside or "latin" not in solid):
                keep[begin:end] = [True] * (end - begin)
        return keep

    @staticmethod
    def _joins(text: str, begin: int) -> bool:
        """A joiner or direction mark with an effect: inside an emoji or beside a letter of a right-to-left or joining script."""
        before, after = text[begin - 1 : begin], text[begin + 1 : begin + 2]

        def emoji(c: str) -> bool:
            return bool(c) and (unicodedata.category(c) in ("So", "Sk") or c == "️")

        def joining(c: str) -> bool:
            return bool(c) and (0x590 <= ord(c) < 0x900 or 0x900 <= ord(c) < 0xE00 or 0xFB50 <= ord(c) < 0xFE00)

        if text[begin] == "‍" and emoji(before) and emoji(after):
            return True
        if text[begin] in "‌‍":
            return joining(before) and joining(after)
        return joining(before) or joining(after)

    def rewrite(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        seen = set()
        # To the fixed point: each pass leaves fewer odd members; a text that returned would end the loop as well.
        while text not in seen:
            seen.add(text)
            out, pos, keep = [], 0, None
            for last, member in self.automaton.iter_long(text):
                begin = last + 1 - len(member)
                if member in _JOINERS and self._joins(text, begin):
                    continue
                if member in self.drawn_alike:
                    if keep is None:
                        keep = self._true_words(text)
                    if keep[begin]:
                        continue
                out += (text[pos:begin], self.best[member])
                pos = last + 1
            if not out:
                return text
            text = "".join(out) + text[pos:]
        return text


def member_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How often each member of a class is in the texts of all rows. Not larger than the fixed table of members."""
    members = {m for c in lookalike_classes() for m in c if m}
    longer = sorted(m for m in members if len(m) > 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for batch in batches:
            for column in columns:
                for text in batch[column].dropna():
                    total.update(text)
                    if not text.isascii():
                        total.update({m: n for m in longer if (n := text.count(m))})
        yield pd.DataFrame([(m, n) for m, n in total.items() if m in members], columns=["member", "n"])

    # Only rows with an odd character can be rewritten, and all that their classes hold is compared among themselves;
    # the plain members are counted over every row all the same.
    counted = df.select(*columns).mapInPandas(count, "member string, n long")
    return {r["member"]: r["n"] for r in counted.groupBy("member").agg(F.sum("n").alias("n")).collect()}


_REWRITERS: dict[str, Rewriter] = {}


def plain_texts(df: DataFrame, id_col: str, columns: Sequence[str], counts: Mapping[str, int] | None = None) -> DataFrame:
    """(id, field_name, text, plain_text, changed) of all values with a character beyond ASCII; the others are plain already."""
    best = representatives(member_counts(df, columns) if counts is None else counts)
    shared = df.sparkSession.sparkContext.broadcast(best)
    key = uuid.uuid4().hex

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = _REWRITERS.get(key)
        if rewriter is None:
            # A worker keeps the rewriter of one run only.
            _REWRITERS.clear()
            rewriter = _REWRITERS[key] = Rewriter(shared.value)
        for batch in batches:
            plain = [rewriter.rewrite(t) for t in batch["text"]]
            batch["changed"] = [p != t for p, t in zip(plain, batch["text"], strict=True)]
            batch["plain_text"] = plain
            yield batch[["_id", "field_name", "text", "plain_text", "changed"]]

    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("text")) for c in columns))
    odd = df.select(F.col(id_col).alias("_id"), F.inline(fields)).filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    kind = dict(odd.dtypes)["_id"]
    out = odd.mapInPandas(rewrite, f"_id {kind}, field_name string, text string, plain_text string, changed boolean")
    return out.withColumnRenamed("_id", id_col)


def rewrite_all(texts: Iterable[str | None], counts: Mapping[str, int] | None = None) -> list[str | None]:
    """The same rewriting of a few texts without Spark."""
    rewriter = Rewriter(representatives(counts or {}))
    return [rewriter.rewrite(t) for t in texts]

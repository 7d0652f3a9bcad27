"""Subject areas of documents by language models.

For each subject an interpolated n-gram model (bigram, unigram, uniform) is trained on labelled documents, beside a background
model of all of them. A sentence's per-token cross-entropy under each subject model is compared with the background's; the
sentence speaks about the subject with the greatest gain, or about none if no gain is clear. Since labels are of whole
documents and some are wrong, models are trained in rounds: after each, sentences go to the subject that claims them.

A document is about every subject that takes at least the calibrated share of its sentences about any subject. Share and gain are
calibrated on the labelled documents.

Training uses at most ``MAX_LABELLED`` labelled documents, chosen by a hash of the id; all documents are scored whole.
Null and blank texts, and texts without a sentence about any subject, have no subject; nor have texts where no sentence is clear
by itself and those that lean to a subject are less than ``LEAST_COVER`` of all. With no labels at all there are no
subjects. Repeated and contradicting labels share a document's weight.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.plain import INVISIBLE, LOOKALIKE_LETTERS

#: The bounded sample of labelled documents that the models are trained on.
MAX_LABELLED = 12_000
ROUNDS = 4
#: Least part of a text's sentences that speak about any subject, in texts without one sentence that is clear by itself.
LEAST_COVER = 0.38
# Gains are measured in units of the most that one word can say, the logarithm of the number of subjects: what is taken for
# nothing, what speaks for a subject by itself (against other labels of the document, or amid plain sentences), and the levels that are tried in calibration.
_DEAD_ZONE, _CLEAR, _LEVELS = 0.28, 1.6, (0.48, 0.65, 0.8, 1.0)
_PRIOR = 4.0
_LAMBDA = (0.35, 0.60, 0.05)  # bigram, unigram, uniform
_MARKUP = re.compile(r"<[^<>]{0,300}>|&[a-z]+;|https?://\S+")
_SENTENCE = re.compile(r"[.!?؟۔¡¿\n\r|]+|(?<=[:;])\s")
# Letters drawn like Latin ones are folded in words that have a Latin letter.
_UNSEEN = dict.fromkeys(map(ord, INVISIBLE))
_DRAWN_ALIKE = str.maketrans({k: v for k, v in LOOKALIKE_LETTERS.items()})
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, lower case, without markup; hyphens part words."""
    if not text:
        return []
    plain = _MARKUP.sub("\n", unicodedata.normalize("NFKC", text.translate(_UNSEEN))).lower()
    if not plain.isascii():
        plain = re.sub(r"[^\W\d_]*[a-z][^\W\d_]*", lambda m: m.group().translate(_DRAWN_ALIKE), plain)
    found = (_WORD.findall(s) for s in _SENTENCE.split(plain))
    return [s for s in found if s]


class SubjectModels:
    """Interpolated models of subjects against a background, kept as one table of gains by n-gram."""

    def __init__(self, subjects: Sequence[str]) -> None:
        self.subjects = list(subjects)
        self.words: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        #: Gain in nats of each subject over the background for a word, and for a word behind a certain word.
        self.table = np.zeros((1, len(self.subjects)), dtype=np.float32)
        self.unit = float(np.log(max(2, len(self.subjects))))
        self.least_gain = _LEVELS[0] * self.unit
        self.least_share = 0.3

    def learn_words(self, said: Sequence[list[str]]) -> None:
        for s in said:
            last = -1
            for w in s:
                at = self.words.setdefault(w, len(self.words))
                if last >= 0:
                    self.pairs.setdefault((last, at), len(self.pairs))
                last = at

    def _indexes(self, said: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all words in a row: the word's id, the pair's id (the numbers of words and pairs if unknown); sentences' starts."""
        words, pairs, unknown, no_pair = self.words, self.pairs, len(self.words), len(self.pairs)
        uni: list[int] = []
        two: list[int] = []
        starts = np.zeros(len(said), dtype=np.int64)
        for i, s in enumerate(said):
            starts[i] = len(uni)
            last = -1
            for w in s:
                at = words.get(w, unknown)
                uni.append(at)
                two.append(pairs.get((last, at), no_pair))
                last = at
        return np.array(uni, dtype=np.int64), np.array(two, dtype=np.int64), starts

    def fit(self, said: Sequence[list[str]], weight: np.ndarray) -> None:
        """``weight``: of each sentence for each subject, in the last column for none."""
        k, v, n = len(self.subjects), len(self.words), len(self.pairs)
        uni, two, starts = self._indexes(said)
        lengths = np.diff(np.append(starts, len(uni)))
        one_count, two_count = np.zeros((v, k + 1)), np.zeros((n, k + 1))
        paired = two < n
        for j in range(k + 1):
            each = np.repeat(weight[:, j], lengths)
            one_count[:, j] = np.bincount(uni, weights=each, minlength=v)[:v]
            two_count[:, j] = np.bincount(two[paired], weights=each[paired], minlength=n)[:n]
        l2, l1, l0 = _LAMBDA
        total = one_count.sum(axis=0)
        part = (total[:k] / max(total.sum(), 1e-9) + 1e-9)[None, :]
        flat = l0 / (v + 1)
        # Counts are shrunk towards the background by a few observations, so that rare words don't decide alone.
        each = one_count.sum(axis=1, keepdims=True)
        back = each / max(total.sum(), 1e-9)
        own = back * (one_count[:, :k] + _PRIOR * part) / ((each + _PRIOR) * part)
        single = np.log((l1 * own + flat) / (l1 * back + flat))
        ends = np.array(list(self.pairs), dtype=np.int64).reshape(-1, 2)
        behind = one_count[ends[:, 0]]
        pair_back = two_count.sum(axis=1, keepdims=True) / np.maximum(behind.sum(axis=1, keepdims=True), 1e-9)
        pair_own = (two_count[:, :k] + _PRIOR * pair_back) / (behind[:, :k] + _PRIOR)
        double = np.log((l2 * pair_own + l1 * own[ends[:, 1]] + flat) / (l2 * pair_back + l1 * back[ends[:, 1]] + flat))
        # Small differences come from which languages and phrases happen to be labelled; a cross-entropy counts beyond them.
        single[np.abs(single) < _DEAD_ZONE * self.unit] = 0
        double[np.abs(double) < _DEAD_ZONE * self.unit] = 0
        self.table = np.vstack([single, np.zeros((1, k)), double]).astype(np.float32)

    def gains(self, said: Sequence[list[str]]) -> np.ndarray:
        """Total gain of each subject's log-likelihood over the background, by sentence; no sentence may be empty."""
        if not said:
            return np.zeros((0, len(self.subjects)))
        uni, two, starts = self._indexes(said)
        index = np.where(two < len(self.pairs), two + len(self.words) + 1, uni)
        out = np.empty((len(said), len(self.subjects)))
        ends = np.append(starts[1:], len(index))
        step = 20_000
        for i in range(0, len(said), step):
            lo, hi = starts[i], ends[min(i + step, len(said)) - 1]
            out[i : i + step] = np.add.reduceat(self.table[index[lo:hi]], starts[i : i + step] - lo, axis=0)
        return out

    def shares(self, gains: np.ndarray, all_covered: bool = False) -> np.ndarray:
        """Share of each subject in a document's sentences about any, from the sentences' gains.

        ``all_covered`` asks for ``LEAST_COVER`` of texts with clear sentences too.
        """
        k = len(self.subjects)
        counts = np.zeros(k)
        if not k or not len(gains):
            return counts
        for _ in range(2):
            # What the rest of the text is about decides between subjects that share a word.
            lean = 0.7 * np.log((counts + 0.5) / (counts.sum() + 0.5 * k)) if counts.sum() else np.zeros(k)
            best = np.argmax(gains + lean, axis=1)
            clear = gains[np.arange(len(gains)), best] >= self.least_gain
            counts = np.bincount(best[clear], minlength=k).astype(float)
        # Remains of pages hold a word of some subject here and there, but no sentence that is clear by itself.
        clear_alone = not all_covered and gains.max() >= max(_CLEAR * self.unit, self.least_gain)
        enough = clear_alone or counts.sum() >= LEAST_COVER * len(gains)
        return counts / counts.sum() if enough and counts.any() else np.zeros(k)

    def accept_all(self, texts: Sequence[str | None]) -> list[list[str]]:
        """The accepted subjects of each text."""
        said = [sentences(t) for t in texts]
        gains = self.gains([s for d in said for s in d])
        out, at = [], 0
        for d in said:
            share = self.shares(gains[at : at + len(d)])
            at += len(d)
            out.append([s for s, x in zip(self.subjects, share, strict=True) if x > 0 and x >= self.least_share])
        return out


def train(labelled: Sequence[tuple[str, dict[str, float]]], subjects: Sequence[str]) -> SubjectModels:
    """``labelled``: texts with the weight of each label."""
    models = SubjectModels(sorted(subjects))
    k = len(models.subjects)
    at = {s: i for i, s in enumerate(models.subjects)}
    said, weights, docs = [], [], []
    for text, labels in labelled:
        weight = np.zeros(k + 1)
        for subject, w in labels.items():
            if subject in at:
                weight[at[subject]] += w
        if weight.sum() and (found := sentences(text)):
            docs.append((len(said), len(said) + len(found), {s for s in labels if s in at}))
            said += found
            weights += [weight / weight.sum()] * len(found)
    if not said:
        return models
    weight = np.array(weights)
    labelled_as = weight[:, :k] > 0
    models.learn_words(said)
    models.fit(said, weight)
    rows = np.arange(len(said))
    for _ in range(ROUNDS):
        gains = models.gains(said)
        # A sentence is given to a label of its document, to another subject only where that explains it far better, else
        # to none; what stands under all labels alike so stays with none.
        own = np.argmax(np.where(labelled_as, gains, -np.inf), axis=1)
        best = np.argmax(gains, axis=1)
        own_gain, best_gain = gains[rows, own], gains[rows, best]
        far = best_gain >= np.maximum(_CLEAR * models.unit, own_gain + _CLEAR * models.unit)
        chosen = np.where(far, best, np.where(own_gain >= models.least_gain, own, k))
        models.fit(said, np.eye(k + 1)[chosen])
    calibrate(models, models.gains(said), docs)
    return models


def calibrate(models: SubjectModels, gains: np.ndarray, docs: Sequence[tuple[int, int, set[str]]]) -> None:
    """Sets the least gain and share to the pair with the best agreement (F1) with the labels."""
    best = (-1.0, models.least_gain, models.least_share)
    names = models.subjects
    for gain in (level * models.unit for level in _LEVELS):
        models.least_gain = gain
        # Labelled texts are about their subjects throughout: a level at which they lose cover misses weaker sentences.
        shares = [models.shares(gains[lo:hi], all_covered=True) for lo, hi, _ in docs]
        for share in (0.2, 0.225, 0.25, 0.275, 0.3):
            hit = told = true = 0
            for x, (_, _, labels) in zip(shares, docs, strict=True):
                got = {names[i] for i in np.nonzero((x > 0) & (x >= share))[0]}
                hit += len(got & labels)
                told += len(got)
                true += len(labels)
            f1 = 2 * hit / (told + true) if told + true else 0.0
            if f1 > best[0]:
                best = (f1, gain, share)
    _, models.least_gain, models.least_share = best


def label_sample(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[tuple[str, dict[str, float]]]:
    """At most ``limit`` labelled documents, least hash of the id first, with the share of each label."""
    voted = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id", "subject").agg(F.count("*").alias("n"))
    chosen = voted.groupBy("doc_id").agg(F.collect_list(F.struct("subject", "n")).alias("votes")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most ``limit`` ids are broadcast, so that only their texts move.
    wanted = documents.filter("text is not null").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    texts = wanted.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = chosen.join(texts, "doc_id").orderBy("doc_id").collect()
    out = []
    for row in rows:
        total = sum(v["n"] for v in row["votes"])
        out.append((row["text"], {v["subject"]: v["n"] / total for v in sorted(row["votes"])}))
    return out


_MODELS: dict[str, SubjectModels] = {}


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, subject): the subjects each document is about."""
    names = [r["subject"] for r in subjects.select("subject").filter("subject is not null").distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 subjects")
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(train(label_sample(documents, labels, limit), names))
    key = uuid.uuid4().hex

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = _MODELS.get(key)
        if models is None:
            # A worker keeps the models of one run only.
            _MODELS.clear()
            models = _MODELS[key] = shared.value
        for batch in batches:
            batch["subjects"] = models.accept_all(list(batch["text"]))
            yield batch[["doc_id", "subjects"]]

    texts = documents.select("doc_id", "text").filter(F.col("text").rlike(r"\S"))
    kind = dict(texts.dtypes)["doc_id"]
    scored = texts.mapInPandas(score, f"doc_id {kind}, subjects array<string>")
    return scored.select("doc_id", F.explode("subjects").alias("subject")).distinct()

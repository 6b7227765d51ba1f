"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding lowers case, maps look-alike letters of other scripts to Latin ones, reads digits and signs that
stand for letters inside words as those letters, and leaves one space between words. A lexicon entry is a
whole word, or a beginning of at least SHORTEST letters that several different words of toxic texts share.
Entries inside an exception phrase do not count. Weights are log odds of document frequencies, learned with
the calibration from a bounded sample of labelled rows; every document is scored on its whole text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, held_out, map_rows, materialize, one_of_each

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝһαεικνορτυχ", "abekmhopctyxijsdqwhaeikvoptux"))
# Digits and signs that stand for letters.
SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi"))
# Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "clown fish", "clown car", "loser tree", "sore loser")

#: Labelled rows learned from at most.
SAMPLE_ROWS = 20_000
#: Shortest and longest beginning of words, and different words of toxic texts that must begin like that.
SHORTEST, LONGEST, LEAST_WORDS = 5, 8, 3
#: Toxic documents an entry must be in, deviations that are taken off their number, least weight.
LEAST_DOCUMENTS, DEVIATIONS, LEAST_WEIGHT = 3, 1.0, 2.5
#: Parts of the sample that are scored with what the others teach.
FOLDS = 8

_LOOK = {ord(k): v for k, v in LOOKALIKES.items()}
_SUBST = {ord(k): v for k, v in SUBSTITUTES.items()}
_TOKEN = re.compile(r"[\w@$!]+")
_LETTER, _SIGN = re.compile(r"[^\W\d_]"), re.compile(r"[\d@$!]")
_BREAK = re.compile(r"[\W_]+")
_FOREIGN = re.compile("[Ͱ-ӿԀ-ԯ＀-￯\U0001d400-\U0001d7ff]")


def _plain_token(m: re.Match) -> str:
    """A run of letters, digits and signs with these read as letters, if it has a letter. Signs of
    exclamation at its end, and three or more signs at either end, stand for none and go."""
    token = m[0].rstrip("@$!")
    if len(m[0]) - len(token) < 3:
        token = m[0].rstrip("!")
    bare = token.lstrip("@$!")
    if len(token) - len(bare) >= 3:
        token = bare
    return token.translate(_SUBST) if _SIGN.search(token) and _LETTER.search(token) else token


def fold(text: str) -> str:
    """Words of a text, folded, each with one space before and one after. Time is linear in the text."""
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(_LOOK)
    else:
        text = text.lower()
    if _SIGN.search(text):
        text = _TOKEN.sub(_plain_token, text)
    return f" {_BREAK.sub(' ', text).strip()} "


def beginnings(word: str) -> list[str]:
    """The entries ' beginning' of a word."""
    return [f" {word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST) + 1)]


def entries_of(folded: str) -> set[str]:
    """What the lexicon could hold of a text: ' word ' of words with a letter, and ' beginning'."""
    out = set()
    for w in set(folded.split()):
        if _LETTER.search(w):
            out.add(f" {w} ")
            out.update(beginnings(w))
    return out


@dataclass
class Lexicon:
    """Entries with weights, and the calibration of a score: intercept and factors of features()."""

    weights: dict[str, float]
    factors: list[float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (w, len(entry), False))
        for phrase in self.exceptions:
            p = f" {phrase} "
            a.add_word(p, (0.0, len(p), True))
        if len(a):
            a.make_automaton()
        return a


def matches(automaton, folded: str) -> dict[int, float]:
    """Start of each matched word to its best weight, without those inside an exception phrase."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (w, n, exception) in automaton.iter(folded):
            start = end - n + 1
            if exception:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
    if spared:
        starts = sorted(best)
        for lo, hi in spared:
            for s in starts[bisect_left(starts, lo) : bisect_left(starts, hi)]:
                best.pop(s, None)
    return best


def features(found: dict[int, float], folded: str) -> list[float]:
    """Weight per word, logged and plain, and the number of matches, damped."""
    n, total = max(1, folded.count(" ") - 1), sum(found.values())
    return [1.0, math.log1p(1000 * total / (n + 10)), min(1.0, 10 * total / (n + 10)), math.log1p(len(found))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _entries(batches):
    """Rows (entry, fold, documents) that add up to the numbers of documents with each entry, by fold."""
    counts: Counter = Counter()
    for pdf in batches:
        for t, fold_no in zip(pdf["t"], pdf["fold"]):
            counts.update((e, fold_no) for e in entries_of(fold(t)))
            if len(counts) > 300_000:
                yield _rows_of(counts)
                counts.clear()
    yield _rows_of(counts)


def _rows_of(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame(
        {"entry": pd.Series([e for e, _ in counts], dtype="object"), "fold": np.array([k for _, k in counts], dtype="int32"), "documents": np.array(list(counts.values()), dtype="int64")}
    )


def _by_fold(found: DataFrame) -> DataFrame:
    """(entry, n) with n the numbers of documents of each fold."""
    return found.groupBy("entry").agg(F.array(*(F.sum(F.when(F.col("fold") == k, F.col("documents")).otherwise(0)) for k in range(FOLDS))).alias("n"))


def _weights(sample: DataFrame, sizes: dict[tuple[int, bool], int]) -> list[dict[str, float]]:
    """For each fold every entry of LEAST_WEIGHT or more that the other folds teach, and at last those that all teach."""
    toxic = materialize(_by_fold(sample.where("y > 0").mapInPandas(_entries, "entry string, fold int, documents bigint")), "toxicity-entries")
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x)
    word = F.trim("entry")
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length(word), F.lit(LONGEST)))
    begun = toxic.where(F.col("entry").endswith(" ") & (F.length(word) >= SHORTEST)).select(
        F.explode(F.transform(lengths, lambda k: F.concat(F.lit(" "), F.substring(word, F.lit(1), k)))).alias("entry"),
        *((total > F.col("n")[k]).cast("int").alias(f"w{k}") for k in range(FOLDS)),  # in toxic texts of other folds too
    )
    begun = begun.groupBy("entry").agg(F.array(*(F.sum(f"w{k}") for k in range(FOLDS)), F.count("*")).alias("words"))
    often = toxic.where(total >= LEAST_DOCUMENTS).join(begun, "entry", "left").select("entry", "n", "words").collect()  # entries of at most SAMPLE_ROWS rows
    wanted = {r["entry"] for r in often}

    def count_wanted(batches):
        counts: Counter = Counter()
        for pdf in batches:
            for t, fold_no in zip(pdf["t"], pdf["fold"]):
                counts.update((e, fold_no) for e in entries_of(fold(t)) & wanted)
        yield _rows_of(counts)

    clean = {r["entry"]: r["n"] for r in _by_fold(sample.where("y <= 0").mapInPandas(count_wanted, "entry string, fold int, documents bigint")).collect()}
    discard(toxic)
    entries = [r["entry"] for r in often]
    whole = np.array([e.endswith(" ") for e in entries], dtype=bool)
    words = np.array([r["words"] or [0] * (FOLDS + 1) for r in often], dtype=np.int64).reshape(-1, FOLDS + 1)
    seen = _without_each([r["n"] for r in often])
    harmless = _without_each([clean.get(e, [0] * FOLDS) for e in entries])
    n_toxic, n_clean = (_without_each([[sizes.get((k, label), 0) for k in range(FOLDS)]]) for label in (True, False))
    with np.errstate(divide="ignore", invalid="ignore"):  # entries without toxic texts in the other folds
        weights = np.log((seen - DEVIATIONS * np.sqrt(seen)) / (n_toxic + 1)) - np.log((harmless + 0.5) / (n_clean + 1))
        kept = (seen >= LEAST_DOCUMENTS) & (whole[:, None] | (words >= LEAST_WORDS)) & (weights >= LEAST_WEIGHT)
    return [{entries[j]: float(weights[j, k]) for j in np.flatnonzero(kept[:, k])} for k in range(FOLDS + 1)]


def _without_each(by_fold: list[list[int]]) -> np.ndarray:
    """Sums of each row without its first fold, without its second, and so on, and at last of all folds."""
    n = np.array(by_fold, dtype=np.int64).reshape(-1, FOLDS)
    return np.hstack([n.sum(axis=1, keepdims=True) - n, n.sum(axis=1, keepdims=True)])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: Column | None = None) -> Lexicon:
    """Learn from the SAMPLE_ROWS labelled rows of smallest hashed id, of those for which ``keep`` holds.

    The weight of an entry is its log odds in toxic and clean documents, DEVIATIONS taken off the toxic ones;
    every entry of LEAST_WEIGHT or more is in the lexicon, however rare, with no limit on their number but the
    sample. For the calibration each of FOLDS parts of the sample is scored with what the other parts teach, so
    that entries met by chance are not trusted. Null labels and null ids are left out, a repeated id counts
    once, with the text of the smallest hash. Without a toxic row the lexicon is empty and every score is low.
    """
    chosen = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(SAMPLE_ROWS)
    rows = documents.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")  # SAMPLE_ROWS rows of two numbers at most
    sample = materialize(one_of_each(rows, "i", F.xxhash64("t")).withColumn("fold", F.pmod(F.xxhash64("i", F.lit(7)), F.lit(FOLDS)).cast("int")), "toxicity-sample")

    sizes = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", (F.col("y") > 0).alias("toxic")).count().collect()}
    *parts, lexicon = (Lexicon(w, []) for w in _weights(sample.select("t", "y", "fold"), sizes))

    def look(batches):
        taught = [p.automaton() for p in parts]
        for pdf in batches:
            folded = [fold(t) for t in pdf["t"]]
            yield pd.DataFrame({"x": [features(matches(taught[k], f), f) for f, k in zip(folded, pdf["fold"])], "y": pdf["y"].clip(0, 1).astype("float64")})

    seen = sample.select("t", "y", "fold").mapInPandas(look, "x array<double>, y double").collect()
    discard(sample)
    x, y = np.array([r["x"] for r in seen]).reshape(-1, 4), np.array([r["y"] for r in seen])
    lexicon.factors = _logistic(x, y).tolist() if y.sum() and lexicon.weights else [-4.0, 0.0, 0.0, 0.0]
    return lexicon


def score(documents: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", out_col: str = "score") -> DataFrame:
    """(id_col, out_col double in 0..1, n_matches, matched_weight) of every whole text; one narrow pass.

    A null or empty text has no match and the lowest score. Repeated rows and null ids stay as they are.
    Tasks receive the lexicon, which grows with the sample it was learned from and not with the documents.
    """

    def run(batches):
        a, w = lexicon.automaton(), np.array(lexicon.factors)
        for pdf in batches:
            x, n, total = [], [], []
            for t in pdf["t"]:
                f = fold(t or "")
                found = matches(a, f)
                x.append(features(found, f))
                n.append(len(found))
                total.append(sum(found.values()))
            z = np.array(x).reshape(-1, 4) @ w
            yield pd.DataFrame({"i": pdf["i"], out_col: 1 / (1 + np.exp(-np.clip(z, -40, 40))), "n_matches": pd.Series(n, dtype="int64"), "matched_weight": pd.Series(total, dtype="float64")})

    return map_rows(documents, id_col, {"t": F.col(text_col)}, run, f"`{out_col}` double, n_matches bigint, matched_weight double")


def reject(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of documents, all columns, whose score is below the threshold. Null texts stay."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, w = lexicon.automaton(), lexicon.factors  # once a task
        for texts in batches:
            out = []
            for t in texts:
                f = fold(t or "")
                z = sum(p * q for p, q in zip(features(matches(a, f), f), w))
                out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            yield pd.Series(out, dtype="float64")

    return documents.where(F.col(text_col).isNull() | (of(F.col(text_col)) < threshold))


def fit_on_labels(documents: DataFrame, labels: DataFrame) -> Lexicon:
    """fit() on the rows that are not held out (crc32 of the id modulo 5 is 0)."""
    return fit(documents, labels, keep=~held_out(F.col("i"), 5, 0))

"""Language identification: multinomial naive Bayes over hashed character n-grams.

The logs of the n-gram probabilities form one matrix (buckets by languages) that tasks receive by
broadcast; a batch of texts is scored in numpy by looking up the matrix rows of its n-grams only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, held_out, map_rows, materialize, one_of_each

UNDETERMINED = "und"
#: Documents learned from at most; n-gram lengths; smoothing.
SAMPLE_ROWS, LENGTHS, SMOOTHING = 20_000, (1, 2, 3, 4), 0.5
#: Buckets, halved (FEWEST at least) while buckets times languages exceed CELLS: every language is learned.
BUCKETS, FEWEST, CELLS = 1 << 16, 1 << 10, 1 << 24
#: Characters scored at once.
BLOCK = 500_000

_OTHER = re.compile(r"[\W\d_]+")


def _clean(text: str | None) -> str:
    return f" {_OTHER.sub(' ', (text or '').lower()).strip()} "


def buckets_for(languages: int) -> int:
    buckets = BUCKETS
    while buckets > FEWEST and buckets * languages > CELLS:
        buckets //= 2
    return buckets


def _buckets(codes: np.ndarray, left: np.ndarray, n: int, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of the n-gram at each place; buckets where its text has fewer than n characters left."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.where(left[:size] >= n, (h >> np.uint64(40)) % np.uint64(buckets), buckets).astype(np.int64)


def _blocks(texts: list[str]):
    """(first text, codes, texts' lengths) of runs of about BLOCK characters; never splits a text."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            part = texts[lo : i + 1]
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            yield lo, codes, np.array([len(x) for x in part])
            lo, size = i + 1, 0


@dataclass
class Model:
    """Languages, log prior of each, and log probability by bucket and language (a last row of zeros)."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By cleaned text and language, and the number of n-grams by text."""
        out, grams, buckets = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), len(self.matrix) - 1
        for first, codes, lengths in _blocks(texts):
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
            for n in LENGTHS:
                at = _buckets(codes, left, n, buckets)
                full = np.full(len(codes), buckets, dtype=np.int64)
                full[: len(at)] = at
                out[first : first + len(lengths)] += np.add.reduceat(self.matrix[full], starts, axis=0, dtype=np.float64)
                grams[first : first + len(lengths)] += np.maximum(lengths - n + 1, 0)
        return out, grams


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: Column | None = None) -> Model:
    """Learn from the SAMPLE_ROWS rows of smallest hashed id that have a language and for which keep holds.

    Rows with a null text or id are left out; of a repeated id the row with the smallest hash of its text
    counts. Every language of the sample is learned. With no such row the model knows no language, and every
    prediction is ``und``.
    """
    rows = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("y")).where("i is not null and t is not null and y is not null")
    if keep is not None:
        rows = rows.where(keep)
    ids = rows.select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(SAMPLE_ROWS)
    sample = materialize(one_of_each(rows.join(F.broadcast(ids), "i"), "i", F.xxhash64("t"), F.col("y")).select("t", "y"), "language-sample")  # SAMPLE_ROWS numbers at most
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    buckets = buckets_for(len(languages))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("y"):
                if len(sums) * buckets > CELLS:  # memory stays bounded with any number of languages
                    yield from frames(sums)
                total = sums.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                for _, codes, lengths in _blocks([_clean(t) for t in part["t"]]):
                    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
                    for n in LENGTHS:
                        total += np.bincount(_buckets(codes, left, n, buckets), minlength=buckets + 1)
        yield from frames(sums)

    def frames(sums):
        for lang, total in sums.items():
            at = total[:buckets].nonzero()[0]
            yield pd.DataFrame({"y": lang, "bucket": at, "n": total[at]})
        sums.clear()

    counted = sample.mapInPandas(count, "y string, bucket bigint, n bigint").groupBy("y", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # CELLS rows at most, or FEWEST a language
    discard(sample)
    counts = np.zeros((buckets, len(languages)))
    column = {y: k for k, y in enumerate(languages)}
    counts[got["bucket"].to_numpy(dtype=np.int64), got["y"].map(column).to_numpy(dtype=np.int64)] = got["n"]
    counts += SMOOTHING
    matrix = np.zeros((buckets + 1, len(languages)), dtype=np.float32)
    matrix[:buckets] = np.log(counts / counts.sum(axis=0))
    prior = np.log(np.array([sizes[y] for y in languages], dtype=float) / max(1, sum(sizes.values()))) if languages else np.zeros(0)
    return Model(languages, prior, matrix)


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every whole text; one narrow pass.

    score is the posterior of the language taken, with the evidence divided by the square root of the
    number of n-grams, since neighbouring n-grams are not independent. A null text or one without any
    letter is ``und`` with score 0; repeated rows and null ids stay; equal scores go to the first
    language by code point.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # CELLS floats at most (64 MB), or FEWEST a language of the bounded sample

    def run(batches):
        m = sent.value
        for pdf in batches:
            n = len(pdf)
            lang, best = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
            at = np.flatnonzero(pdf["letters"].to_numpy(dtype=bool))
            if len(at) and m.languages:
                texts = pdf["t"].to_numpy()
                ll, grams = m.log_likelihoods([_clean(texts[k]) for k in at])
                z = (ll + m.prior) / np.sqrt(np.maximum(grams, 1))[:, None]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                lang[at] = np.array(m.languages, dtype=object)[z.argmax(axis=1)]
                best[at] = z.max(axis=1) / z.sum(axis=1)
            yield pd.DataFrame({"i": pdf["i"], "lang_pred": lang, "score": best})

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return map_rows(documents, id_col, {"t": F.col(text_col), "letters": letters}, run, "lang_pred string, score double")


def fit_on_documents(documents: DataFrame) -> Model:
    """fit() on the rows that are not held out (crc32 of the id modulo 4 is 2)."""
    return fit(documents, keep=~held_out(F.col("i"), 4, 2))

"""Removal of repeated strings of THRESHOLD bytes, by prefix doubling over sampled positions.

Plain doubling ranks every position of the corpus again and again: at 8 bytes for a position and 8 for its
rank, each of seven rounds moves some 16 times the text. Two facts make it small. A name can stand for a rank:
equal strings get equal 64-bit hashes without sorting, so sorting is only needed to see which names are alone.
And of each window of THRESHOLD bytes one position may stand for all: its anchor, the place of the least
hashed gram in it, which equal windows share.

1. Rank at GRAM bytes: anchors (about 1 position in 40) are grouped by the name of their gram. Those that
   are alone are unique and leave; no window that they stand for can repeat.
2. Rank at the whole context of an anchor, the windows that it stands for: among equal contexts each but the
   first repeats an earlier one, and all its windows are settled. If all contexts of a gram are equal, the
   first is settled too. A context is told by one 64-bit name within its gram.
3. First contexts of grams that go on differently are ranked at half the way to the threshold: a window holds,
   besides the gram, half of what it has more on the left or on the right of it, so the names of the gram with
   its left and with its right neighbourhood are compared, and the windows on a side that is alone leave.
4. What is left is ranked window by window at the threshold, by the pair of the names of its halves; each
   window but the first of a pair repeats. Windows with equal names are in the same group of step 3, so a
   group of at most TOGETHER sides is sent to one task as a whole, as the bytes of its sides; the windows of
   larger groups are grouped by name over all tasks.
5. Removed bytes are the union of the repeating windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import discard, free_shuffles, map_rows, materialize, shuffle_partitions, whole_groups

THRESHOLD, GRAM, BLOCK, TOGETHER = 100, 24, 1 << 18, 4096
_rng = np.random.default_rng(23)
_T1, _T2 = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _P and of its inverse, modulo 2**64."""
    size = 1 << max(19, (n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_P, _P_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Names:
    """Hashes of any substrings of a byte array."""

    def __init__(self, data: np.ndarray, table: np.ndarray):
        up, self.down = _powers_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]


def anchors(data: np.ndarray, valid: np.ndarray, threshold: int = THRESHOLD, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Of the anchors of the windows that are valid: name of the gram (h) and of the context (s), first window
    (lo), number of windows (n) and of those on the left side (k), and 32-bit names of both sides (e)."""
    width = threshold - gram + 1
    grams = _mix(Names(data, _T1).grams(gram))
    place = np.uint64((1 << 20) - 1)
    least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    covered = 1
    while covered * 2 <= width:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    if covered < width:
        least = np.minimum(least[: len(least) - (width - covered)], least[width - covered :])
    at = np.flatnonzero(valid[: len(least)])
    anchor = (least[at] & place).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    lo, q = at[head], anchor[head]
    names = Names(data, _T2)
    s = _mix(names.of(lo, lo + n - 1 + threshold) + (q - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    # Windows that start at q - before or earlier hold the left side, the others the right one.
    before = (threshold - gram + 1) // 2
    after = threshold + 1 - before
    k = np.clip(q - before - lo + 1, 0, n)
    left = _mix(names.of(np.maximum(q - before, 0), q + gram))
    right = _mix(names.of(q, np.minimum(q + after, len(data))))
    e = (left & np.uint64(0xFFFFFFFF00000000)) | (right >> np.uint64(32))
    return {"h": grams[q].view(np.int64), "s": s.view(np.int64), "lo": lo, "n": n, "k": k, "e": e.view(np.int64)}


def _pieces(texts, threshold: int):
    """(row, offset, bytes) of texts, a long one in overlapping pieces so that each window is in one piece."""
    for k, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        for lo in range(0, max(0, len(b) - threshold + 1), BLOCK):
            yield k, lo, b[lo : lo + BLOCK + threshold - 1]


def _anchor_rows(threshold: int, gram: int, brief: bool):
    def block(docs: np.ndarray, pieces: list) -> pd.DataFrame:
        data = np.frombuffer(b"".join(b for _, _, b in pieces), dtype=np.uint8)
        lengths = np.array([len(b) for _, _, b in pieces])
        starts = np.cumsum(lengths) - lengths
        valid = np.ones(len(data), dtype=bool)
        for e in starts + lengths:
            valid[max(0, e - threshold + 1) : e] = False
        found = anchors(data, valid, threshold, gram)
        if brief:
            return pd.DataFrame({"h": found["h"]})
        piece = np.searchsorted(starts, found["lo"], side="right") - 1
        rows, offsets = np.array([r for r, _, _ in pieces]), np.array([o for _, o, _ in pieces])
        found |= {"doc": docs[rows[piece]], "lo": found["lo"] - starts[piece] + offsets[piece]}
        return pd.DataFrame({c: found[c] for c in ("h", "s", "doc", "lo", "n", "k", "e")})

    def run(batches):
        for pdf in batches:
            docs, part, size = pdf["doc"].to_numpy(), [], 0
            for piece in _pieces(pdf["t"], threshold):
                part.append(piece)
                size += len(piece[2])
                if size >= BLOCK:
                    yield block(docs, part)
                    part, size = [], 0
            if part:
                yield block(docs, part)

    return run


def _sides(threshold: int):
    """The bytes of each side listed for a text, (lo, n) being its windows, with its group g and whether
    that is large."""

    def run(batches):
        for pdf in batches:
            g, doc, lo, n, large, piece = [], [], [], [], [], []
            for d, text, los, ns, gs, big in zip(pdf["doc"], pdf["t"], pdf["los"], pdf["ns"], pdf["gs"], pdf["bigs"]):
                b = text.encode("utf-8", "surrogatepass")
                g.append(gs)
                doc.append(np.full(len(los), d))
                lo.append(los)
                n.append(ns)
                large.append(big)
                piece += [b[x : x + k - 1 + threshold] for x, k in zip(los.tolist(), ns.tolist())]
            yield pd.DataFrame({"g": np.concatenate(g), "doc": np.concatenate(doc), "lo": np.concatenate(lo), "n": np.concatenate(n), "large": np.concatenate(large), "piece": piece})

    return run


def _window_names(pdf: pd.DataFrame, threshold: int) -> tuple[np.ndarray, ...]:
    """(row, window from the row's first, name of its first half, of its second) of all windows of sides."""
    names = Names(np.frombuffer(b"".join(pdf["piece"]), dtype=np.uint8), _T2)
    n = pdf["n"].to_numpy()
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(ends - n, n)
    at = np.repeat(ends - n + np.arange(len(n)) * (threshold - 1), n) + inside
    half = threshold // 2
    a, b = (_mix(names.of(at + x, at + y)).view(np.int64) for x, y in ((0, half), (half, threshold)))
    return row, inside, a, b


def _names_of_windows(threshold: int):
    def run(batches):
        for pdf in batches:
            row, inside, a, b = _window_names(pdf, threshold)
            yield pd.DataFrame({"a": a, "b": b, "doc": pdf["doc"].to_numpy()[row], "lo": pdf["lo"].to_numpy()[row] + inside})

    return run


def _repeating_windows(threshold: int):
    """Runs of windows (doc, lo, n) that are not the earliest of their names, from sides sorted by group."""

    def run(batches):
        for pdf in whole_groups(batches, "g"):
            row, inside, a, b = _window_names(pdf, threshold)
            g, doc, lo = pdf["g"].to_numpy()[row], pdf["doc"].to_numpy()[row], pdf["lo"].to_numpy()[row] + inside
            order = np.lexsort((lo, doc, b, a, g))
            later = np.zeros(len(order), dtype=bool)
            x, y = order[1:], order[:-1]
            later[x] = (g[x] == g[y]) & (a[x] == a[y]) & (b[x] == b[y])
            at = np.flatnonzero(later)
            new = np.ones(len(at), dtype=bool)
            new[1:] = (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1)
            head = np.flatnonzero(new)
            yield pd.DataFrame({"doc": doc[at[head]], "lo": lo[at[head]], "n": np.diff(np.append(head, len(at)))})

    return run


def _cut(threshold: int):
    def run(batches):
        for pdf in batches:
            size, removed, runs, digests = [], [], [], []
            for text, los, ns in zip(pdf["t"], pdf["los"], pdf["ns"]):
                b = (text or "").encode("utf-8", "surrogatepass")
                gone, n, at, kept = 0, 0, 0, hashlib.sha256()
                end = -1
                spans = sorted(zip(los.tolist(), (los + ns - 1 + threshold).tolist())) if los is not None else ()
                for lo, hi in spans:
                    if lo > end:
                        kept.update(b[max(end, 0) : lo])
                        n += 1
                        at, end = lo, hi
                        gone += hi - lo
                    elif hi > end:
                        gone += hi - end
                        end = hi
                kept.update(b[max(end, 0) :])
                size.append(len(b))
                removed.append(gone)
                runs.append(n)
                digests.append(kept.hexdigest())
            yield pd.DataFrame({"i": pdf["i"], "n_bytes": pd.Series(size, dtype="int64"), "n_removed": pd.Series(removed, dtype="int64"), "n_spans": pd.Series(runs, dtype="int64"), "kept_sha256": digests})

    return run


def _repeating(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The rows of df (keys, doc, lo, ...) that are not the earliest of their keys."""
    least = df.groupBy(*keys).agg(F.min(F.struct("doc", "lo")).alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    least = materialize(least, label)
    free_shuffles(df.sparkSession)
    later = (F.col("least.doc") != F.col("doc")) | (F.col("least.lo") != F.col("lo"))
    return df.join(least, keys).where(later).drop("least")


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(doc, lo, n) for docs (doc bigint unique, t string): n windows from byte lo on that repeat earlier
    ones. Windows may be listed in several rows."""
    spark = docs.sparkSession
    brief = docs.mapInPandas(_anchor_rows(threshold, gram, True), "h bigint")
    shared = materialize(brief.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-grams")
    free_shuffles(spark)
    every = docs.mapInPandas(_anchor_rows(threshold, gram, False), "h bigint, s bigint, doc bigint, lo bigint, n bigint, k bigint, e bigint")
    known = materialize(every.join(shared, "h"), "suffix-anchors")
    free_shuffles(spark)

    settled = materialize(_repeating(known, ["h", "s"], "suffix-contexts").select("doc", "lo", "n"), "suffix-settled")
    firsts = known.groupBy("h", "s").agg(F.min(F.struct("doc", "lo", "n", "k", "e")).alias("f")).select("h", "f.*")
    firsts = materialize(firsts.withColumns({"l": F.shiftright("e", 32), "r": F.expr("e & 4294967295")}), "suffix-firsts")
    free_shuffles(spark)
    discard(known, shared)
    sides = []
    for side, own, lo, n in (("l", F.col("k") > 0, F.col("lo"), F.col("k")), ("r", F.col("n") > F.col("k"), F.col("lo") + F.col("k"), F.col("n") - F.col("k"))):
        some = firsts.where(own)
        several = some.groupBy("h", side).agg(F.count("*").alias("c")).where("c > 1").select("h", side, (F.col("c") > TOGETHER).alias("big"))
        joined = some.join(materialize(several, f"suffix-several-{side}"), ["h", side])
        sides.append(joined.select("doc", lo.alias("lo"), n.alias("n"), F.xxhash64("h", side, F.lit(side)).alias("g"), "big"))
    lists = (F.collect_list(c).alias(f"{c}s") for c in ("lo", "n", "g", "big"))
    open_ = materialize(sides[0].unionByName(sides[1]).groupBy("doc").agg(*lists), "suffix-open")
    free_shuffles(spark)
    discard(firsts)

    pieces = docs.join(open_, "doc").mapInPandas(_sides(threshold), "g bigint, doc bigint, lo bigint, n bigint, large boolean, piece binary")
    pieces = materialize(pieces, "suffix-sides")
    free_shuffles(spark)
    small = pieces.where("not large").select("g", "doc", "lo", "n", "piece").repartition(shuffle_partitions(spark), "g").sortWithinPartitions("g")
    small = materialize(small.mapInPandas(_repeating_windows(threshold), "doc bigint, lo bigint, n bigint"), "suffix-small-groups")
    windows = pieces.where("large").select("doc", "lo", "n", "piece").mapInPandas(_names_of_windows(threshold), "a bigint, b bigint, doc bigint, lo bigint")
    windows = materialize(windows, "suffix-windows")
    discard(pieces)
    later = _repeating(windows, ["a", "b"], "suffix-pairs").select("doc", "lo", F.lit(1).cast("bigint").alias("n"))
    later = materialize(later, "suffix-large-groups")
    free_shuffles(spark)
    discard(windows)
    return settled.unionByName(small).unionByName(later)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) for each row of df.

    Bytes covered by a string of ``threshold`` bytes that starts earlier too (smaller id, or earlier in the
    same text) are removed; all is judged on the input. A null text is empty. Ids may be numbers or text; null
    ids come last. Rows that repeat an id with other texts are ordered by a hash of the text; rows that agree in
    id and text are one document, so each of them gets its result. Texts below the threshold lose nothing.
    """
    kind = df.schema[id_col].dataType
    named = df.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    whole = isinstance(kind, IntegralType)
    plain = whole and named.groupBy("doc").agg(F.count("*").alias("k")).where("k > 1 or doc is null").isEmpty()
    if plain:
        docs = named.select(F.col("doc").alias("id"), F.col("doc").cast("bigint").alias("doc"), "t")
    else:  # numbers that grow in the order of ids and hashes, from the places in sorted ranges
        hashed = named.withColumn("th", F.xxhash64("t"))
        ordered = hashed.select("doc", "th").distinct().repartitionByRange(shuffle_partitions(df.sparkSession), F.col("doc").asc_nulls_last(), "th").sortWithinPartitions(F.col("doc").asc_nulls_last(), "th")
        ranks = materialize(ordered.select(F.col("doc").alias("d"), F.col("th").alias("h"), F.monotonically_increasing_id().alias("rank")), "suffix-ranks")
        docs = hashed.join(ranks, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select(F.col("doc").alias("id"), F.col("rank").alias("doc"), "t")
        docs = materialize(docs, "suffix-ranked")
    spans = repeated_spans(docs.select("doc", "t") if plain else docs.select("doc", "t").dropDuplicates(["doc"]), threshold, gram)
    spans = materialize(spans.groupBy("doc").agg(F.collect_list("lo").alias("los"), F.collect_list("n").alias("ns")), "suffix-spans")
    free_shuffles(df.sparkSession)
    joined = docs.join(spans, "doc", "left").select("id", "t", "los", "ns")
    cut = map_rows(joined, "id", {c: F.col(c) for c in ("t", "los", "ns")}, _cut(threshold), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return cut.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")

"""Self-join of documents on the Jaccard similarity of their word n-grams, by chosen paths.

1. One pass over the texts: the set of hashed n-grams, its digest, and a minhash signature of it.
   Documents with equal sets form a class, known by that digest; only the class goes on.
2. Candidates. Each run starts with all classes in one node. A node samples one or two signature places
   (1 / similarity on average) and splits its members by the tokens that they have there, so that two
   similar sets stay together in one child on average. Nodes of at most BUCKET members are compared by
   brute force on short sketches; larger ones are split again, and after DEPTH splits their members, which
   have agreed on DEPTH sampled tokens, are chained. Runs are repeated until the chance that a pair of the
   least similarity met in none falls below 1 - RECALL. Paths do not depend on the data, so all runs go
   through the same shuffles, and only class ids and paths are shuffled.
3. Exact check. Candidates that hang together are compared in blocks, set against set, in numpy. A task
   returns only the number of links of each class and a spanning forest, never the pairs; a large group
   is dealt out as pairs of blocks.
4. Links make components, the classes' ids.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_shuffles, materialize, shuffle_partitions, sorted_groups
from tidemark.llm.components import components, forest, least_members

N, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Signature places; members of a node compared at once; splits; members of a block in the exact check.
PLACES, BUCKET, DEPTH, BLOCK = 128, 48, 4, 192
#: Sketch agreement below which a pair cannot be similar: five standard deviations below SIMILARITY.
SLACK = 5.0

_WORDS = re.compile(r"\w+")
_MIX, _MASK = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1
_hashes: dict[str, int] = {}
_A = np.random.default_rng(11).integers(1, 1 << 63, PLACES, dtype=np.uint64) | np.uint64(1)


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    if len(_hashes) > 250_000:
        _hashes.clear()
    get, of = _hashes.get, xxhash.xxh64_intdigest
    out = np.empty(len(words), dtype=np.uint64)
    for k, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _hashes[w] = of(w)
        out[k] = h
    return out


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words (lower case letters, digits, underscores).
    A text of fewer words has one run, of all its words; one without words has none."""
    words = _WORDS.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = _word_hashes(words)
    size = max(1, len(h) - n + 1)
    out = np.full(size, len(words) if len(words) < n else n, dtype=np.uint64)
    for k in range(min(n, len(h))):
        out = (out ^ h[k : k + size]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(tokens: np.ndarray) -> np.ndarray:
    """PLACES minhashes, 32 bits each."""
    low = np.full(PLACES, _MASK, dtype=np.uint64)
    for at in range(0, len(tokens), 2048):
        low = np.minimum(low, (tokens[at : at + 2048, None] * _A[None, :]).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def runs_needed(similarity: float, recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair of the least similarity has met with probability recall."""
    stay, second = 1.0, 1 / similarity - 1  # a node takes a second place with probability second
    for _ in range(depth):
        one = similarity * stay
        stay = (1 - second) * one + second * (1 - (1 - one) ** 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - stay)))


def _children(rows: DataFrame, similarity: float) -> DataFrame:
    """(path, class) of the children of the nodes rows (path, class, sig)."""
    place = lambda k: F.pmod(F.xxhash64("path", F.lit(k)), F.lit(PLACES)).cast("int")
    child = lambda c: F.xxhash64("path", c, F.get("sig", c))
    second = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(1 << 20)) < F.lit(int((1 / similarity - 1) * (1 << 20)))
    paths = F.when(second & (place(1) != place(2)), F.array(child(place(1)), child(place(2)))).otherwise(F.array(child(place(1))))
    return rows.select(F.explode(paths).alias("path"), "class")


def _compare(least: float):
    """Members of small nodes, sorted by path, to candidate links: a forest for each node."""

    def run(batches):
        for group in sorted_groups(batches, "path"):
            if len(group) < 2:
                continue
            own = group["class"].to_numpy()
            sketch = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(len(own), -1)
            i, j = np.triu_indices(len(own), 1)
            alike = (sketch[i] == sketch[j]).mean(axis=1) >= least
            if alike.any():
                root = forest(len(own), i[alike], j[alike])
                some = np.flatnonzero(root != np.arange(len(own)))
                yield pd.DataFrame({"a": own[some], "b": own[root[some]]})

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by products of 0/1 matrices over common tokens."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    tokens = np.intersect1d(a, b)
    if not len(tokens):
        return out
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    at = [np.searchsorted(tokens, x) for x in (a, b)]
    found = [tokens[np.minimum(k, len(tokens) - 1)] == x for k, x in zip(at, (a, b))]
    for lo in range(0, len(tokens), 8192):
        width = min(8192, len(tokens) - lo)
        part = []
        for r, k, f, n in zip(rows, at, found, out.shape):
            m = np.zeros((n, width), dtype=np.float32)
            own = f & (k >= lo) & (k < lo + width)
            m[r[own], k[own] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _check(similarity: float):
    """Pairs of blocks of candidate groups, sorted by task, to links: rows (a, b, n, m): a and b hang
    together; a has n other documents linked, b has m (0 for both where only the forest speaks)."""

    def run(batches):
        for group in sorted_groups(batches, "task"):
            side = group["side"].to_numpy()
            same = not (side == 1).any() or not (side == 0).any()
            parts = [group] if same else [group[side == 0], group[side == 1]]
            sets = [[np.frombuffer(x, dtype=np.uint64) for x in p["tokens"]] for p in parts]
            own = [p["class"].to_numpy() for p in parts]
            copies = [p["copies"].to_numpy() for p in parts]
            sizes = [np.array([len(x) for x in s], dtype=np.float64) for s in sets]
            common = _overlaps(sets[0], sets[-1])
            linked = common >= similarity * (sizes[0][:, None] + sizes[-1][None, :] - common) - 1e-9
            if same:
                np.fill_diagonal(linked, False)
            n = [linked @ copies[-1], linked.T @ copies[0]][: len(parts)]
            i, j = linked.nonzero()
            both = np.concatenate(own)
            root = forest(len(both), i, j if same else j + len(own[0]))
            yield pd.DataFrame({"a": both, "b": both[root], "n": np.concatenate(n).astype(np.int64)})

    return run


def _linked(df: DataFrame, id_col: str, text_col: str, n: int, similarity: float, recall: float) -> DataFrame:
    """(doc, th, class_id, rep_id, n_links, kept) of each row of df with an id; th is a hash of its text.

    Inside, classes have numbers of their own and rows too, so ids may be of any type that has an order, and
    may repeat."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    t = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(t).alias("th"), t.alias("t"))

    def digest(batches):
        import xxhash

        for pdf in batches:
            keys, sigs = [], []
            for t in pdf["t"]:
                s = shingles(t, n)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"i": pdf["i"], "th": pdf["th"], "key": keys, "sig": sigs})
        _hashes.clear()  # workers live on for other stages

    digests = docs.select(F.col("doc").cast("string").alias("i"), "th", "t").mapInPandas(digest, "i string, th bigint, key binary, sig binary")
    digests = materialize(digests.select(F.col("i").cast(kind).alias("doc"), "th", "key", "sig", F.monotonically_increasing_id().alias("row")), "ngram-digests")
    classes = digests.where("key is not null").groupBy("key").agg(F.min(F.struct("doc", "th", "row")).alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.select("key", F.monotonically_increasing_id().alias("class"), "first", "copies"), "ngram-classes")

    # Signatures of the classes: each class's first row has one.
    @F.pandas_udf("array<int>")
    def unpacked(sig: pd.Series) -> pd.Series:
        return sig.map(lambda x: np.frombuffer(x, dtype=np.int32))

    firsts = digests.where("key is not null").select("row", "sig").join(classes.select(F.col("first.row").alias("row"), "class").hint("merge"), "row")
    firsts = materialize(firsts.select("class", unpacked("sig").alias("sig")), "ngram-signatures")

    rows = firsts.withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.lit(runs_needed(similarity, recall))), lambda r: F.xxhash64(r))))
    leaves, chained, passed = [], None, [firsts]
    for depth in range(DEPTH):
        children = materialize(_children(rows, similarity), f"ngram-nodes-{depth}")
        counts = children.groupBy("path").agg(F.count("*").alias("members"), F.min("class").alias("first")).where("members > 1")
        salted = materialize(counts.withColumn("salt", F.explode(F.when(F.col("members") > BUCKET, F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(-1))))), f"ngram-counts-{depth}")
        small = children.join(salted.where("salt < 0").select("path"), "path")
        leaves.append(small.select("path", "class"))
        large = children.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(16)).cast("int")).join(salted.where("salt >= 0").select("path", "salt", "first"), ["path", "salt"])
        large = materialize(large.select("path", "class", "first"), f"ngram-large-{depth}")
        passed += [children, salted, large]
        if depth == DEPTH - 1:
            chained = large.where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b"))
        elif large.isEmpty():
            break
        else:
            rows = large.select("path", "class").join(firsts.hint("merge"), "class")

    @F.pandas_udf("binary")
    def sketch(sig: pd.Series) -> pd.Series:
        return sig.map(lambda x: (np.asarray(x, dtype=np.int32) & 255).astype(np.uint8).tobytes())

    members = leaves[0]
    for x in leaves[1:]:
        members = members.unionByName(x)
    members = members.join(firsts.select("class", sketch("sig").alias("sketch")).hint("merge"), "class").select("path", "class", "sketch")
    least = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / PLACES)
    parts = shuffle_partitions(spark)
    candidates = members.repartition(parts, "path").sortWithinPartitions("path").mapInPandas(_compare(least), "a bigint, b bigint")
    if chained is not None:
        candidates = candidates.unionByName(chained)
    candidates = materialize(candidates.distinct(), "ngram-candidates")
    discard(*passed)
    groups = components(candidates)

    # The members of each group: the nodes below, and the smallest node itself.
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    sizes = groups.groupBy("component").agg(F.count("*").alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("blocks") > 1, 15).otherwise(0))))
    spread = materialize(spread, "ngram-group-sizes")
    salt = F.pmod(F.xxhash64("node"), F.lit(16)).cast("int")
    one = groups.join(spread.where("blocks = 1").select("component", "blocks"), "component")
    more = groups.withColumn("salt", salt).join(spread.where("blocks > 1").select("component", "salt", "blocks"), ["component", "salt"]).drop("salt")
    dealt = one.unionByName(more.select(*one.columns)).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumnRenamed("node", "class").join(classes.select("class", "first.doc", "first.th", "copies"), "class")
    dealt = materialize(dealt, "ngram-groups")
    free_shuffles(spark)

    def tokens(batches):
        for pdf in batches:
            yield pdf.assign(tokens=[shingles(t, n).tobytes() for t in pdf["t"]]).drop(columns="t")

    # Both sides grow with the rows, so they meet by shuffles at any size; one shuffle serves both steps.
    own = docs.join(dealt.hint("merge"), ["doc", "th"]).dropDuplicates(["doc", "th"])
    own = own.select("class", "component", "block", "blocks", "copies", "t").mapInPandas(tokens, "class bigint, component bigint, block int, blocks int, copies bigint, tokens binary")
    # Block k meets every block: as side 0 those from k on, as side 1 those before.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = own.withColumn("other", other).withColumn("side", (F.col("other") < F.col("block")).cast("int"))
    tasks = tasks.withColumn("task", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    found = tasks.select("task", "side", "class", "copies", "tokens").repartition(parts, "task").sortWithinPartitions("task").mapInPandas(_check(similarity), "a bigint, b bigint, n bigint")
    found = materialize(found, "ngram-links")
    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked"))
    heads = least_members(found.where("a <> b"), classes.select(F.col("class").alias("node"), "first"))
    described = classes.join(links, "class", "left").join(heads.select(F.col("node").alias("class"), F.col("least").alias("head")), "class", "left")
    described = described.select("key", "copies", F.col("first.doc").alias("rep"), F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("head", "first").alias("head"))
    described = materialize(described, "ngram-classes-described")
    discard(classes, candidates, spread, dealt, found, heads)
    out = digests.select("doc", "th", "row", "key").join(described, "key", "left")
    return out.select(
        "doc",
        "th",
        F.coalesce("head.doc", "doc").alias("class_id"),
        F.coalesce("rep", "doc").alias("rep_id"),
        F.coalesce(F.col("linked") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        (F.coalesce("head.row", "row") == F.col("row")).alias("kept"),
    )


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(id_col, class_id, rep_id, n_links, kept) for each row of df.

    rep_id: smallest id with the same set of n-grams; n_links: other rows whose set has at least the
    given Jaccard similarity, copies included; class_id: smallest id that links lead to; kept: the row is
    the one that stays of its class. Texts without words (null, empty) have no links and stay alone, and so
    does each row of them. Rows with a null id link with nothing and stay. Ids may be numbers or text; class_id
    and rep_id have their type. Each row counts for itself, also where an id repeats: rows of one id with
    different texts belong to the classes of their texts, and of equal rows one is kept. An empty table gives
    an empty table.
    """
    kind = df.schema[id_col].dataType
    none = F.lit(None).cast(kind)
    bare = df.where(F.col(id_col).isNull()).select(F.col(id_col), none.alias("class_id"), none.alias("rep_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"))
    found = _linked(df, id_col, text_col, n, similarity, recall)
    return found.select(F.col("doc").alias(id_col), "class_id", "rep_id", "n_links", "kept").unionByName(bare)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that stay: one document of each class, texts without words, and rows with a
    null id. Rows are told apart by id and text; of several that agree in both, one stays."""
    found = _linked(df, id_col, text_col, N, SIMILARITY, RECALL)
    leaving = found.groupBy(F.col("doc").alias("_gone_id"), F.col("th").alias("_gone_hash")).agg(F.count("*").alias("_rows"), F.count(F.when(F.col("kept"), 1)).alias("_stay")).where("_stay < _rows")
    leaving = materialize(leaving, "ngram-leaving")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    on = lambda rows: (F.col(id_col) == rows["_gone_id"]) & (hashed == rows["_gone_hash"])
    out = df.join(leaving.hint("merge"), on(leaving), "left_anti")
    several = leaving.where("_stay > 0")
    if several.isEmpty():
        return out
    one = df.join(several, on(several), "left_semi").withColumn("_gone_hash", hashed).dropDuplicates([id_col, "_gone_hash"]).drop("_gone_hash")
    return out.unionByName(one)

r"""Secrets in texts, with linking of credentials that come in several parts; DataFrame operations only.

Strong candidates are reported wherever they are: assignments of a password or the like (assign), access
identifiers (access) and long hexadecimal strings (hex). Weak ones are only reported near a part that
completes them: a run of 40 or more base64 characters, padding included (key), near an identifier, a user or client name (user) near a secret,
an address (endpoint) near either. Parts are joined on intervals: the text of a document is cut into scopes of
SCOPE characters, a weak part meets the parts of its own and the neighbouring scopes, and the distance decides.

Positions come from two arrays: the matches of a pattern and the pieces between them; running sums of their
lengths over a document's matches are the ends. Positions count code points, ends are exclusive. Work grows in
proportion to a text and its parts: overlaps come from running ends over a document's parts in order, masked
texts from blocks. Only lengths are shuffled, no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Characters of a scope; of a block that masked texts are put together from.
SCOPE, BLOCK = 400, 4096
# The patterns of the strong kinds; the group and length that a match must have.
STRONG = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Weak kinds, by role.
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])", 0, 40),
    "user": (r"""(?<![A-Za-z0-9_])(?i:(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", 1, 3),
    "endpoint": (r"[a-z][a-z0-9+.]{0,31}://[^\s\"'<>]+", 0, 10),
}
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "user": "identifier", "endpoint": "endpoint"}
KINDS = [*STRONG, *WEAK]
#: Hexadecimal runs are looked for at once with their least length: a shorter run holds no longer one.
_SEARCH = {"hex": r"[0-9a-f]{24,}"}
_MATCHES = "array<struct<kind:int,gap:bigint,len:bigint,long:boolean>>"
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _texts_of(kind: str, text: Column) -> Column:
    pattern = {**STRONG, **WEAK}[kind][0]
    found = F.regexp_extract_all(text, F.lit(_SEARCH.get(kind, pattern)), F.lit(0))
    if kind == "access":
        return F.when(F.contains(text, F.lit("AKIA")), found)
    if kind == "endpoint":
        return F.when(F.contains(text, F.lit("://")), found)
    return found


def _matches_of(kind: str, text: Column, found: Column) -> Column:
    """Of each match the length, that of the piece before it, and whether it is long enough."""
    pattern, group, least = {**STRONG, **WEAK}[kind]
    value = (lambda m: m) if group == 0 else (lambda m: F.regexp_extract(m, pattern, group))
    each = lambda m, p: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.char_length(p).cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("len"), (F.char_length(value(m)) >= least).alias("long"))
    return F.coalesce(F.when(F.size(found) > 0, F.zip_with(found, F.split(text, _SEARCH.get(kind, pattern), -1), each)), F.array().cast(_MATCHES))


def found_matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, matches) for each row: the matches of all kinds, each kind's in order. k1 and k2 stand for
    text and id in joins."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    step = df.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("k1"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k2"), t.alias("t"))
    step = step.select("*", *(_texts_of(k, F.col("t")).alias(f"m_{k}") for k in KINDS))
    return step.select("id", "k1", "k2", F.concat(*(_matches_of(k, F.col("t"), F.col(f"m_{k}")) for k in KINDS)).alias("matches"))


def placed_parts(found: DataFrame) -> DataFrame:
    """(k1, k2, s, weak): each part with its place s (start, kind, end), weak parts that overlap a strong one
    left out: the strong parts up to a weak one in order of starts end before it, and those after it start
    behind it."""
    rows = found.where(F.size("matches") > 0).select("k1", "k2", "matches").dropDuplicates(["k1", "k2"])
    each = rows.select("k1", "k2", F.posexplode("matches").alias("pos", "m")).where("m.len is not null")  # the last piece has no match
    upto = lambda *keys: Window.partitionBy("k1", "k2", *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.select("k1", "k2", "pos", "m", F.col("m.kind").alias("kind"))
    each = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(upto("kind").orderBy("pos"))).where("m.long")
    each = each.select("k1", "k2", F.struct((F.col("end") - F.col("m.len")).alias("start"), "kind", "end").alias("s"), (F.col("kind") >= len(STRONG)).alias("weak"))
    each = each.withColumn("before", F.max(F.when(~F.col("weak"), F.col("s.end"))).over(upto().orderBy("s")))
    each = each.withColumn("after", F.min(F.when(~F.col("weak"), F.col("s.start"))).over(upto().orderBy(F.desc("s"))))
    overlaps = F.coalesce(F.col("before") > F.col("s.start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("s.end"), F.lit(False))
    return each.where(~F.col("weak") | ~overlaps).select("k1", "k2", "s", "weak")


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), kind + 1)


def linked_parts(parts: DataFrame) -> DataFrame:
    """(k1, k2, s): weak parts that a complementary one within SCOPE characters confirms."""
    side = parts.withColumn("role", _role(F.col("s.kind")))
    first, last = F.floor(F.col("s.start") / SCOPE), F.floor(F.col("s.end") / SCOPE)
    # A long part reaches into each scope that it touches.
    every = side.select("k1", "k2", F.explode(F.sequence(first - 1, last + 1)).alias("scope"), F.col("s").alias("o"), F.col("role").alias("other"))
    reach = side.where("weak").select("k1", "k2", F.explode(F.sequence(first, last)).alias("scope"), "s", "role")
    distance = F.greatest(F.col("s.start") - F.col("o.end"), F.col("o.start") - F.col("s.end"))
    completes = F.when(F.col("role") == "secret", F.col("other") == "identifier").when(F.col("role") == "identifier", F.col("other") == "secret").otherwise(F.col("other") != "endpoint")
    same = (reach["k1"] == every["k1"]) & (reach["k2"] == every["k2"]) & (reach["scope"] == every["scope"])
    return reach.join(every, same & (distance <= SCOPE) & completes, "left_semi").select("k1", "k2", "s").distinct()


def _joined(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans, k1, k2, all_spans) for each row of df.

    A null text counts as empty. Rows that agree in id and text get equal results; null ids stay; other
    columns are left out; a text without any match gives zeros, the digest of nothing and an empty string.
    Everything found stays within a row, so no key gathers rows but a document's own parts.
    """
    found = materialize(found_matches(df, id_col, text_col), "secret-matches")
    parts = materialize(placed_parts(found), "secret-parts")
    every = parts.where("not weak").select("k1", "k2", "s").unionByName(linked_parts(parts))
    every = every.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    out = found.select("id", "k1", "k2").join(every, ["k1", "k2"], "left").withColumn("all_spans", F.coalesce("spans", F.array().cast(_SPANS)))
    out = out.withColumn("base", F.filter("all_spans", lambda s: s["kind"] < len(STRONG)))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select(F.col("id").alias(id_col), *(n(k) for k in STRONG), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"), "k1", "k2", "all_spans")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """df, all rows and columns, with each found span of the text replaced by a mark; overlapping spans
    become one mark. A null text stays null."""
    found = find_secrets(df, id_col, text_col).where(F.size("all_spans") > 0).select("k1", "k2", "all_spans").dropDuplicates(["k1", "k2"])
    # What stays: from the furthest end so far to the next start, where that is not behind it.
    each = found.select("k1", "k2", F.explode("all_spans").alias("s"))
    earlier = Window.partitionBy("k1", "k2").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("at", F.coalesce(F.max("s.end").over(earlier), F.lit(0)))
    gaps = F.collect_list(F.when(F.col("s.start") >= F.col("at"), F.struct(F.col("at").alias("lo"), F.col("s.start").alias("hi"))))
    kept = each.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.array_sort(gaps).alias("_gaps"), F.max("s.end").alias("_end"))
    keys = (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_k1")) & (F.coalesce(F.col(id_col).cast("string"), F.lit("")) == F.col("_k2"))
    t = F.col(text_col)
    some = F.col("_end").isNotNull() & t.isNotNull()
    joined = df.join(kept, keys, "left").withColumn("_blocks", F.when(some, F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def piece(lo: Column, hi: Column) -> Column:
        first = F.floor(lo / BLOCK)
        blocks = F.slice(F.col("_blocks"), (first + 1).cast("int"), (F.floor(hi / BLOCK) - first + 1).cast("int"))
        return F.array_join(blocks, "").substr((lo - first * BLOCK + 1).cast("int"), (hi - lo).cast("int"))

    pieces = F.transform("_gaps", lambda g: piece(g["lo"], g["hi"]))
    new = F.array_join(F.concat(pieces, F.array(piece(F.col("_end"), F.char_length(t).cast("bigint")))), mark)
    text = F.when(some, new).otherwise(t)
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in df.columns))

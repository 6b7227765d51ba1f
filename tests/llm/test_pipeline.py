"""The pipeline against plain versions of its stages."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, sentencepiece_bpe, toxicity
from test_operators import brute_links, plain_weak

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked(text):
    out, at = [], 0
    spans = sorted((int(a), int(e)) for _, a, e in (x.split(":") for x in plain_weak(text).split(",") if x))
    for a, e in spans:
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, e)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append((name, docs.columns, rows))
    return out


def test_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "ngram_join", "secrets", "mixing", "sentencepiece"]
    assert all(c == COLUMNS for _, c, _ in stages[:-1])


def test_stages(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = toxicity.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    automaton, kept = lexicon.automaton(), {}
    for r in docs.collect():
        f = toxicity.fold(r["text"] or "")
        z = sum(p * q for p, q in zip(toxicity.features(toxicity.matches(automaton, f), f), lexicon.factors))
        if 1 / (1 + math.exp(-z)) < 0.5:
            kept[r["doc_id"]] = r["text"]
    got = {r["doc_id"]: r["text"] for r in stages[0][2]}
    assert sorted(got.keys() ^ kept.keys()) == [] and got == kept and len(kept) < docs.count()

    _, label = brute_links(list(kept.items()))
    ones = {i: t for i, t in kept.items() if label[i] == i}
    assert {r["doc_id"]: r["text"] for r in stages[1][2]} == ones and len(ones) < len(kept)

    clean = {i: masked(t) for i, t in ones.items()}
    assert {r["doc_id"]: r["text"] for r in stages[2][2]} == clean
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2][2])

    sizes, queue = mixing.mix(spark.createDataFrame(stages[2][2], ",".join(f"{c} {t}" for c, t in docs.dtypes)))
    times = {r["doc_id"]: r["n"] for r in queue.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert Counter(r["doc_id"] for r in stages[3][2]) == Counter(times)
    assert all(r["text"] == clean[r["doc_id"]] for r in stages[3][2])

    model = sentencepiece_bpe.model_at()
    ids = {i: model.encode(clean[i]) for i in times}
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in stages[4][2])
    assert got == Counter({(i, len(ids[i]), hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest()): n for i, n in times.items()})


def test_run_gives_the_rows_of_the_stages(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in rows) == Counter((r["doc_id"], r["ids_sha256"]) for r in stages[-1][2])

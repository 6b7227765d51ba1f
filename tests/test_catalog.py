import pytest

import oracle
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert oracle.difference(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], duck) is None


def test_queries_on_an_unknown_source(spark, sf_dir):
    from tidemark.operators import samples

    df = catalog.event_samples(spark, sf_dir)
    assert samples.newest(samples.of_source(df, -1), 3).count() == 0
    assert samples.latest_ts(df, -1).first()[0] is None


def test_codec_roundtrip_sends_all_samples_through_each_encoding(spark, sf_dir, monkeypatch):
    from tidemark.sources import codecs

    encode, sent = codecs.encode, {}
    monkeypatch.setattr(codecs, "encode", lambda df, name, path: (sent.update({name: df.count()}), encode(df, name, path))[1])
    n = catalog.codec_roundtrip(spark, sf_dir).count()
    assert n == catalog.events(spark, sf_dir).count() and sent == dict.fromkeys(codecs.ENCODINGS, n)

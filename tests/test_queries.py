import pytest

from lakeveil.plans import oracles, queries


def test_every_query_but_the_checksums_has_sql():
    assert set(queries.QUERIES) - set(oracles.ORACLES) == {"detect_crypto"}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], oracles.ORACLES[name])


def test_crypto_checksums(spark, small_dir):
    rows = queries.detect_crypto(spark, small_dir).collect()
    assert sorted(r.value for r in rows) == ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"]

import pytest

from lakesieve import queries as q

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, sf, con, name):
    same(q.queries()[name](spark, sf), con, q.oracle_sql()[name])


def test_shuffle_is_a_seeded_permutation(spark, sf):
    first = [r["id"] for r in q.deterministic_shuffle(spark, sf).collect()]
    again = [r["id"] for r in q.rows.seeded_shuffle(q.corpus(spark, sf).repartition(7).select("id", "lang"), "id", 42).collect()]
    assert first == again != sorted(first) and sorted(first) == list(range(len(first)))


def test_shown_records_shows_every_record(spark):
    sf = "/root/testdata/sf0.01"
    c = q.table(spark, sf, "conversations")
    assert c.count() > 100 and q.shown_records(spark, sf).count() == c.count() + c.where("role = 'user'").count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

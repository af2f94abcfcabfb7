import pytest

from tests.oracle import DATA, differences
from weft import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.SQL[name])[:3] == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_all_candidates_are_ranked(spark):
    data = "/root/testdata/sf0.01"  # sf0.001 has fewer than 20
    every = [tuple(r) for r in queries.QUERIES["candidate_rank_vector_all"](spark, data).collect()]
    assert len(every) > 20 and every[:20] == [tuple(r) for r in queries.QUERIES["candidate_rank_vector"](spark, data).collect()]

import os

import pytest

from folioforge.plans import registry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")


#: columns without nulls, of queries that SQL can't compute; what they hold is tested by unit tests
FILLED = {
    "m10_planar_points": ["x", "y"], "m11_vector_text": ["encoded", "numbers"], "s18_sentence_summaries": ["doc_id"], "sc16_searched_candidates": ["query_id", "title"], "u1_hash_embeddings": ["query_id"],
}


@pytest.fixture(scope="module")
def con():
    return oracle.connection(oracle.DATA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    oracle.assert_same(spark, registry.queries()[name], registry.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    rows = registry.queries()[name](spark, oracle.DATA).collect()
    assert rows and all(r[c] is not None for r in rows for c in FILLED[name])

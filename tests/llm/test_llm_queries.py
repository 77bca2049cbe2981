import os

import pytest

from folioforge.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")


#: keys of the queries that SQL can't compute
KEYS = {
    "p2_found": ["hn_id", "paper_id"], "p2_matches": ["hn_id", "paper_id"], "p3_pieces": ["item_kind", "item_id", "piece_no"], "p4_found": ["query_id", "feedback_item_id"], "p4_reliability": ["rater", "family"],
    "p5_neighbors": ["example_id", "rank"], "p6_sequences": ["sequence_id", "position"], "p6_fill": ["sequences"], "p7_selection": ["doc_id", "source"], "p7_shares": ["source"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    plan = queries.queries()[name]
    if name in queries.oracle_sql():
        oracle.assert_same(spark, plan, queries.oracle_sql()[name], oracle.connection(oracle.DATA))
    else:  # what its rows must be like is tested by the queries of ``invariants``
        rows = plan(spark, oracle.DATA).collect()
        key = KEYS[name]
        assert rows and len({tuple(r[c] for c in key) for r in rows}) == len(rows) and all(r[c] is not None for r in rows for c in key)

import pytest

import compare
from quern.llm import queries

pytestmark = pytest.mark.skipif(not compare.FOLDER.exists(), reason="no test tables here")


def test_queries_equal_their_sql(spark):
    own = {n: q for n, q in queries.QUERIES.items() if not n.endswith("_bpe")}
    assert compare.differences(spark, own, queries.SQL) == {}

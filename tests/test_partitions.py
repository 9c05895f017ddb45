"""Steps that hold their rows in memory are dealt over partitions in proportion to the input."""

import pytest

from quillnet.operators import graph
from quillnet.plans import lifecycle
from quillnet.plans.queries import QUERIES, SQL
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(graph, "PART_BYTES", 8 << 10)


def test_rows_of_a_partition_do_not_grow_with_the_input(spark, small_parts):
    pairs = lifecycle.order_parts(spark, SF)
    n = graph.parts(pairs)
    assert n > 8
    sizes = pairs.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == n and max(sizes) < 4 * sum(sizes) / n


def test_small_inputs_keep_the_engines_number(spark):
    assert graph.parts(lifecycle.order_parts(spark, SF)) == 0
    assert graph.parts(spark.createDataFrame([(1,)], "a int")) == 0


@pytest.mark.parametrize("name", ["kept_documents", "doc_pair_ratio", "rational", "alias_lookup_join", "cooccurrence_npmi", "edges_filtered", "comention_file"])
def test_dealt_queries_equal_their_sql(spark, small_parts, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(oracle(SF).sql(SQL[name]).df())

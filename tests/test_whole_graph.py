import datetime
from itertools import combinations

import pytest

from marlstone.plans import registry

registry.load()
HEAVY, LIGHT = [f"Brand#1{i}" for i in range(8)], [f"Brand#2{i}" for i in range(4)]


@pytest.fixture(scope="module")
def two_cliques(spark, tmp_path_factory):
    """28 edges of weight 9 and, apart from them, 6 of weight 8."""
    d = str(tmp_path_factory.mktemp("graph"))
    part = {b: i for i, b in enumerate(HEAVY + LIGHT)}
    orders = [pair for names, times in ((HEAVY, 9), (LIGHT, 8)) for pair in combinations(names, 2) for _ in range(times)]
    spark.createDataFrame([(i, b, "TIN") for b, i in part.items()], "p_partkey long, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(k, part[b], n) for k, pair in enumerate(orders) for n, b in enumerate(pair, 1)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, 1, datetime.datetime(1997, 1, 1)) for k in range(len(orders))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["label_propagation", "louvain"])
def test_communities_are_those_of_all_edges(spark, two_cliques, name):
    got = {r.id: r.community for r in registry.QUERIES[name](spark, two_cliques).collect()}
    assert got == {b: names[0] for names in (HEAVY, LIGHT) for b in names}


def test_prompts_of_all_communities(spark, two_cliques):
    got = {r.community: r.prompt for r in registry.QUERIES["community_prompts"](spark, two_cliques).collect()}
    assert set(got) == {HEAVY[0], LIGHT[0]}
    assert all(f"- {a} / {b} (8)" in got[LIGHT[0]] for a, b in combinations(LIGHT, 2))

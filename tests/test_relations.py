import random

from rows import values

from quern.operators import relations
from quern.sources.text import edge_source, itemset_source


def test_pairs_in_string_order(spark, lines):
    items = itemset_source(lines("p,b", "p,a", "p,b", "p,10", "p,9", "q,z", "bad"))
    pairs = [("p", *p) for p in [("10", "9"), ("10", "a"), ("10", "b"), ("9", "a"), ("9", "b"), ("a", "b")]]
    assert values(relations.self_join(items)) == pairs


def test_a_hot_prefix_in_blocks_gives_the_same_pairs(spark):
    random.seed(3)
    rows = [("hot", str(random.randrange(90))) for _ in range(300)] + [(f"p{i % 40}", str(i % 7)) for i in range(300)]
    items = spark.createDataFrame(rows, "prefix string, item string")
    whole = values(relations.self_join(items))
    assert values(relations.self_join(items, block_rows=10)) == whole
    n = len({i for p, i in rows if p == "hot"})
    assert sum(p == "hot" for p, _, _ in whole) == n * (n - 1) // 2


def test_adjacency(spark, lines):
    edges = edge_source(lines("a,b", "a,b", "c,a", "nocomma", "x,y,z"))
    found = values(relations.packed_adjacency(relations.adj_list(edges)))
    assert found == [
        ("a", 0, "from{c}:to{b}"), ("b", 0, "from{a}:to{}"), ("c", 0, "from{}:to{a}"), ("x,y", 0, "from{}:to{z}"), ("z", 0, "from{x,y}:to{}"),
    ]


def test_blocks_of_a_hot_node_hold_every_neighbour_once(spark):
    edges = spark.createDataFrame([(f"s{i:03}", "hub") for i in range(900)] * 2, "src string, dst string")
    hub = [r for r in relations.adj_list(edges, 50).collect() if r.node == "hub"]
    assert {r.side for r in hub} == {"from"} and {r.block for r in hub} == set(range(18))
    assert sorted(n for r in hub for n in r.neighbours) == [f"s{i:03}" for i in range(900)]
    assert all(r.neighbours == sorted(r.neighbours) for r in hub)


def test_every_pair_is_on_both_sides(spark):
    rows = [(str(i % 13), str(i % 7)) for i in range(91)]
    found = relations.adj_list(spark.createDataFrame(rows, "src string, dst string")).collect()
    out = {(r.node, t) for r in found if r.side == "to" for t in r.neighbours}
    back = {(f, r.node) for r in found if r.side == "from" for f in r.neighbours}
    assert out == back == set(rows)

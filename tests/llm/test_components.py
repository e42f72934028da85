import random

from loomseq.llm.components import connected_components, match_groups


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


def test_random_graphs_at_any_partition_size(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(900):04d}", f"n{rng.randrange(900):04d}") for _ in range(600)]
    df = spark.createDataFrame(edges, "a string, b string").repartition(7)
    for rows in (30, 100_000):
        got = connected_components(df, partition_rows=rows).collect()
        assert len(got) == len({r["node"] for r in got})
        assert {r["node"]: r["root"] for r in got} == brute(edges)


def test_long_chain_and_star(spark):
    chain = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(800)]
    star = [("hub", f"leaf{i}") for i in range(1500)]
    df = spark.createDataFrame(chain + star, "a string, b string").repartition(9)
    got = {r["node"]: r["root"] for r in connected_components(df, partition_rows=60).collect()}
    assert got == brute(chain + star)


def test_links_of_hits(spark):
    schema = "query_id string, database_id string, similarity double, nm int, q_len int, t_len int, node string, root string"
    rows = [
        ("a", "b", 0.95, 1, 10, 10, None, None),
        ("b", "a", 0.95, 1, 10, 10, None, None),
        ("b", "c", 96.0, 1, 10, 10, None, None),
        ("c", "d", None, 1, 100, 50, None, None),
        ("d", "e", None, 9, 100, 50, None, None),
        ("f", "f", 1.0, 0, 9, 9, None, None),
        ("g", None, 1.0, 0, 9, 9, None, None),
        ("h", "i", None, None, 9, 9, None, None),
        ("j", "k", None, 0, 0, 9, None, None),
        ("l", "m", float("nan"), 0, 9, 9, None, None),
        ("x", "y", 0.92, 0, 9, 9, None, None),
        ("y", "z", 0.9199, 0, 9, 9, None, None),
    ]
    got = {r["record_id"]: r["group_id"] for r in match_groups(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "l": "l", "m": "l", "x": "x", "y": "x"}
    assert match_groups(spark.createDataFrame([], schema)).count() == 0

import random

from gapline.llm.common import Scratch, connected_components


def test_components_match_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(230)]
    edges += [(1000 + k, 1001 + k) for k in range(300)]  # a long path
    edges += [(5000, 5001 + k) for k in range(500)] + [(7, 7)]  # a hub, a loop
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {(x, find(x)) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "hi long, lo long").repartition(7)
    assert {tuple(r) for r in connected_components(df, Scratch(spark, "t")).collect()} == want
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0

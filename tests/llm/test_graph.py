import random

from hearsay.llm.graph import components


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges if None not in e)}


def test_components_with_a_hub(spark):
    rng = random.Random(5)
    edges = [(700, k) for k in range(500, 1400)] + [(k, k + 1) for k in range(2000, 2040)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    edges += [(1, 1), (None, 5), (6, None), (700, 500), (500, 700), (-4, 1399)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute(edges)
    assert found == {x: c for x, c in want.items() if x != c}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

import random

import pytest

from siftline.llm import components as op


@pytest.mark.parametrize("few", [op.TASK_LINKS, 10])
def test_as_union_find(spark, monkeypatch, few):
    """Random links, a hub and a long path, by both ways of meeting a node's smallest neighbour."""
    monkeypatch.setattr(op, "TASK_LINKS", few)
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(5000, 6000 + i) for i in range(70)] + [(900 + i, 901 + i) for i in range(40)]
    of = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            of[b] = a
    assert dict(op.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()) == {x: root(x) for x in of}

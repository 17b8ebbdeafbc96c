import random

import pytest

from glossa.llm import common
from glossa.session import Scratch


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_both_ways(spark, one_task):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (None, 1), (1000, 2), (2, 1000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = common.components(frame, Scratch(spark, "cc"), one_task=one_task).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert common.components(frame.limit(0), Scratch(spark, "cc0"), one_task=one_task).count() == 0

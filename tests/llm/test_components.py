import random

from tallybrook.llm.components import components
from tallybrook.llm.jaccard_join import Forest


def test_components(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000, 5000 + i) for i in range(1, 80)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links = chain + star + loose + [(7, 7), (-5, 2000), (2000, -5)]
    forest = Forest()
    for a, b in links:
        forest.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: forest.find(x) for a, b in links if a != b for x in (a, b)}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

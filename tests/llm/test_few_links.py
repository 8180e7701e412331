import random

from postloom.llm import bagminhash


def test_links_grow_with_the_nodes_not_with_the_buckets(spark):
    """Copies apart that share many buckets: each bucket links all it has, the links kept are few and join the same."""
    r = random.Random(5)
    sets = spark.createDataFrame([(k, [*range(20), 100 + k]) for k in range(40)], "node long, set array<long>")
    held = [(b, n, 21, n, min(own)) for b in range(30) for own in [r.sample(range(40), 30)] for n in own]
    members = spark.createDataFrame(held, "bucket long, node long, layers long, label long, top long")
    links = bagminhash._links_in_blocks(members, sets, 0.8).cache()
    assert links.count() == 30 * 29
    few = bagminhash._fewer(links).cache()
    assert few.count() <= 80
    assert {(x.node, x.label) for x in bagminhash.components(few).collect()} == {(k, 0) for k in range(40)}

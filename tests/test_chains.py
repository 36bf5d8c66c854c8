"""Components of long chains of similar sentences."""

from docweave.operators.clusters import components


def test_low_label_at_the_far_end_of_a_chain(spark):
    """0 - 199 - 198 - ... - 1: everything but the far end first settles on 1, and 0 must still reach all."""
    chain = [0, *range(199, 0, -1)]
    links = [(7, min(x, y), max(x, y)) for x, y in zip(chain, chain[1:], strict=False)] + [(8, 1, 2), (8, 2, 5)]
    nodes = [(7, i) for i in range(201)] + [(8, i) for i in range(6)]
    got = components(spark.createDataFrame(nodes, "doc_id long, pos int"), spark.createDataFrame(links, "doc_id long, a int, b int"))
    want = {(7, i): 0 for i in range(200)} | {(7, 200): 200} | {(8, i): 1 if i in (1, 2, 5) else i for i in range(6)}
    assert {(r.doc_id, r.pos): r.root for r in got.collect()} == want


def test_without_links(spark):
    nodes = spark.createDataFrame([(1, 4), (2, 0)], "doc_id long, pos int")
    got = components(nodes, spark.createDataFrame([], "doc_id long, a int, b int"))
    assert {(r.doc_id, r.pos): r.root for r in got.collect()} == {(1, 4): 4, (2, 0): 0}

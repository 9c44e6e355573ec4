import pytest
from pyspark.sql import functions as F

from rotagraph.functions import kernels as K
from rotagraph.operators import collections, embedding
from rotagraph.sources import graph6, sections


@pytest.fixture(scope="module")
def decided(spark):
    lines = [(graph6.format_g6(n, K.random_planar(n, 2 * n - 3, n)),) for n in range(3, 9)] + [(graph6.format_g6(5, [(0, 1), (3, 4)]),)]
    return embedding.decide(spark.createDataFrame(lines, "g6 string"), "d", certificates=True).cache()


def test_drawings_round_trip(decided):
    texts = sections.drawing_sections(decided)
    rows = sections.parse_drawings(texts).join(decided, "g6").collect()
    assert len(rows) == 7
    for r in rows:
        places = {p.key: (p.pos, p.start, p.end) for p in r.places}
        assert {v.v: (v.pos, v.start, v.end) for v in r.vis_v} == {k: x for k, x in places.items() if k < r.n}
        assert len(places) == r.n + 2 * r.m
    assert sections.parse_drawings(texts.select(F.lit("nothing").alias("section"))).first().places is None


def test_face_texts(decided):
    for r in sections.face_texts(decided).join(decided, "g6").collect():
        walks = [x.split() for x in r.text.splitlines() if x.startswith("  ")]
        assert all(w[0] == w[-1] for w in walks)
        assert sum(len(w) - 1 for w in walks) == 2 * r.m
        assert r.text.count("Component_") == (2 if r.m == 2 else 1)


def test_batch_lines(spark, decided):
    stats = collections.statistics(decided, ["cmd"])
    text = sections.batch_lines(stats, "x/n8.m12.g6")
    got = sections.parse_batch_lines(text).first()
    assert (got.cmd, got.num_graphs, got.num_ok, got.num_nonembeddable, got.error_flag, got.n, got.m) == ("d", 7, 7, 0, "SUCCESS", 8, 12)
    assert sections.parse_batch_lines(spark.createDataFrame([("other",)], "text string")).count() == 0
    assert sections.parse_batch_lines(sections.batch_lines(stats, "all.g6")).first().n is None


def test_edge_lists_and_ranges(spark):
    edges = spark.createDataFrame([(1, 0, 2), (1, 0, 1)], "graph_id long, u int, v int")
    assert sections.edge_list_texts(edges).first().text == "1 2\n1 3\n0 0\n"
    assert sections.parse_range("5, 7-9,8") == [5, 7, 8, 9]
    for bad in ("", "a", "3-1"):
        with pytest.raises(ValueError):
            sections.parse_range(bad)

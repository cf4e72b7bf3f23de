"""The end-to-end plans on a small made-up world, and the streaming product."""

from skysieve.plans import more, objectives, queries


def test_surface_index(spark):
    cube, burnt, reg, labels = more._world(spark, 6, 4.0)
    out = objectives.surface_index(cube, reg, labels, burnt, trees=4, depth=4)
    assert out.grid.count() == cube.count() and out.grid.filter("aqi IS NULL").count() == 0
    assert out.scores.count() == 3 and out.scores.filter("r > 0.3").count() >= 1


def test_hotspots(spark):
    cube, burnt, _, _ = more._world(spark, 12, 3.0)
    out = objectives.hotspots(cube, burnt, reach=8.0, votes=1)
    assert out.votes.count() > 0 and out.history.count() > 0
    assert out.correlation.filter("is_peak").count() == 1 and out.inventory.count() == 3
    assert out.polygons.filter("geometry NOT LIKE 'POLYGON%'").isEmpty()


def test_fill_nodes_are_the_decimals_of_the_sql(spark):
    _, nodes = queries._fill_inputs(spark, "/root/testdata/sf0.001")
    assert {(r.node, r.lat, r.lon) for r in nodes.collect()} == {(i * 100 + j, (80 + 14 * i) / 10, (700 + 13 * j) / 10) for i in range(20) for j in range(20)}

import json

import pytest

from waymill.functions.geometry import assemble
from waymill.operators import exporting as ex

SQUARE = "\n".join(f"n{i} v1 dV T x{x} y{y}" for i, (x, y) in enumerate([(1, 1), (1, 2), (2, 2), (2, 1)], 1))
WAYS = f"""
{SQUARE}
w10 v1 dV T Nn1,n2,n3,n4,n1
w11 v1 dV Tbarrier=fence Nn1,n2,n3,n4,n1
w12 v1 dV Tlanduse=grass Nn1,n2,n3,n4,n1
w13 v1 dV Tbarrier=fence,landuse=grass Nn1,n2,n3,n4,n1
w14 v1 dV Tarea=no,landuse=grass Nn1,n2,n3,n4,n1
w15 v1 dV Tarea=yes,barrier=fence Nn1,n2,n3,n4,n1
w16 v1 dV Tarea=maybe Nn1,n2,n3,n4,n1
w20 v1 dV Tlanduse=grass Nn1,n2,n3
w21 v1 dV Tarea=yes Nn1,n2
"""


@pytest.mark.parametrize(
    ("config", "lines", "areas"),
    [
        ({}, "11 12 13 14 16 20 21", "11 12 13 15 16"),
        ({"linear_tags": True, "area_tags": True}, "11 12 13 14 16 20 21", "11 12 13 15 16"),
        ({"linear_tags": False, "area_tags": False}, "14 20 21", "15"),
        ({"linear_tags": ["barrier"], "area_tags": ["landuse"]}, "11 13 14 20 21", "12 13 15"),
        ({"linear_tags": ["barrier"], "area_tags": None}, "11 13 14 20 21", "12 15 16"),
        ({"linear_tags": None, "area_tags": ["landuse"]}, "11 14 16 20 21", "12 13 15"),
        ({"linear_tags": [], "area_tags": ["landuse"]}, "11 12 13 14 16 20 21", "12 13 15"),
        ({"linear_tags": ["x"], "area_tags": []}, "14 20 21", "11 12 13 15 16"),
    ],
)
def test_lines_and_areas(objects, config, lines, areas):
    made, errors = ex.features(objects(WAYS), ex.read_config(json.dumps(config)))
    found = {"LineString": [], "MultiPolygon": []}
    for r in made.where("type = 'w'").collect():
        found[r.geometry_type].append(r.id)
    assert sorted(found["LineString"]) == [int(x) for x in lines.split()]
    assert sorted(found["MultiPolygon"]) == [int(x) for x in areas.split()]
    assert errors.isEmpty()


def test_untagged_and_filters(objects):
    df = objects(WAYS)
    keep = ex.ExportConfig(keep_untagged=True, geometry_types=("linestring", "point"))
    assert ex.features(df, keep)[0].where("id = 10 or type = 'n'").count() == 5
    only = ex.read_config('{"include_tags": ["landuse"]}', geometry_types=("multipolygon",))
    made = ex.features(df, only)[0]
    assert sorted((r.id, len(r.tags)) for r in made.collect()) == [(12, 1), (13, 1)]
    with pytest.raises(ValueError):
        ex.read_config('{"include_tags": ["a"], "exclude_tags": ["b"]}')
    with pytest.raises(ValueError):
        ex.read_config('{"attributes": {"size": true}}')
    with pytest.raises(ValueError):
        ex.read_config('{"linear_tags": 5}')


def test_incomplete_ways_are_errors(objects):
    df = objects("n1 v1 dV T x1 y1\nw1 v1 dV Ta=b Nn1\nw2 v1 dV Ta=b Nn1,n9\nw3 v1 dV Ta=b N\nr4 v1 dV Ttype=multipolygon,a=b Mw1@")
    made, errors = ex.features(df)
    assert made.isEmpty() and sorted(r.type + str(r.id) for r in errors.collect()) == ["r4", "w1", "w2", "w3"]


AREA = """
n1 v1 dV T x0 y0
n2 v1 dV T x4 y0
n3 v1 dV T x4 y4
n4 v1 dV T x0 y4
n5 v1 dV T x1 y1
n6 v1 dV T x2 y1
n7 v1 dV T x2 y2
w1 v1 dV T Nn1,n2,n3
w2 v1 dV T Nn1,n4,n3
w3 v1 dV T Nn5,n6,n7,n5
r9 v1 dV Ttype=multipolygon,landuse=forest Mw1@outer,w3@outer,w2@
"""


def test_area_with_a_hole(objects):
    made, _ = ex.features(objects(AREA))
    row = made.select("feature_id", ex.wkt().alias("wkt"), "tags").first()
    assert row.feature_id == "a19" and [t.k for t in row.tags] == ["landuse"]
    assert row.wkt == "MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0),(1 1,2 2,2 1,1 1)))"


def test_assembly():
    def way(*points):
        return [(x * 100 + y, x, y) for x, y in points]

    assert assemble([way((0, 0), (1, 0), (1, 1))]) is None
    assert assemble([]) is None
    # A shared side goes: two squares become one ring.
    one = assemble([way((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), way((2, 0), (4, 0), (4, 2), (2, 2), (2, 0))])
    assert len(one) == 1 and len(one[0]) == 1 and len(one[0][0]) == 7
    # An island in a hole is a polygon of its own.
    rings = [way((a, a), (b, a), (b, b), (a, b), (a, a)) for a, b in ((0, 9), (2, 7), (3, 5))]
    assert [len(p) for p in assemble(rings)] == [2, 1]
    # Two rings that meet in a point.
    assert len(assemble([way((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), way((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))])) == 2


POINT = 'n1 v3 dV c4 t2020-01-01T00:00:00Z i5 ume Tname=a%22%b,k=x x1.5 y-2'


def test_geojson(objects):
    config = ex.read_config('{"attributes": {"id": true, "version": "v", "timestamp": true, "user": true, "type": true}}', unique_id="type_id")
    text = ex.geojson_features(ex.features(objects(POINT), config)[0], config).first().json
    assert json.loads(text) == {"type": "Feature", "id": "n1", "geometry": {"type": "Point", "coordinates": [1.5, -2.0]}, "properties": {"@type": "node", "@id": 1, "v": 3, "@user": "me", "@timestamp": 1_577_836_800, "name": 'a"b', "k": "x"}}
    assert '"coordinates":[1.5,-2.0]' in text
    count = ex.ExportConfig(unique_id="counter")
    made = ex.geojson_features(ex.features(objects(WAYS), count)[0], count).collect()
    assert sorted(json.loads(r.json)["id"] for r in made) == list(range(1, 13))
    refs = ex.read_config('{"attributes": {"way_nodes": true}}', geometry_types=("linestring",))
    made = ex.geojson_features(ex.features(objects(WAYS), refs)[0].where("id = 20"), refs).first().json
    assert json.loads(made)["properties"] == {"@way_nodes": [1, 2, 3], "landuse": "grass"}


def test_text_and_copy(objects):
    config = ex.ExportConfig({"id": "@id", "way_nodes": "@refs"}, geometry_types=("linestring", "point"), unique_id="type_id")
    made = ex.features(objects(POINT + "\n" + WAYS.replace("n1 v1", "n9 v1")), config)[0]
    assert ex.text_features(made.where("id = 1"), config).first().line == 'n1 POINT(1.5 -2) @id=1,name=a"b,k=x'
    line = ex.pg_features(made.where("id = 1"), config).first().line
    assert line == 'n1\t0101000020E6100000000000000000F83F00000000000000C0\t1\t\\N\t{"name":"a\\\\"b","k":"x"}'
    hstore = ex.ExportConfig(format_options={"tags_type": "hstore"})
    assert ex.pg_features(ex.features(objects(POINT), hstore)[0], hstore).first().line.endswith('\t"name"=>"a\\\\"b","k"=>"x"')
    area = ex.ExportConfig(geometry_types=("polygon",))
    hexed = ex.pg_features(ex.features(objects(AREA), area)[0], area).first().line
    assert hexed.startswith("0106000020E6100000010000000103000020E61000000200000005000000")

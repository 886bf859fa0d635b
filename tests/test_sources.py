import re

import pytest
from pyspark.sql import functions as F

from waymill.model import Dataset, Header
from waymill.sources import boundaries, debug, files, ids, o5m, opl, pbf, xmlfile

LINES = """
n1 v1 dV c1 t2020-01-01T00:00:00Z i7 uUschi%20%Müller Tname=Straße%2c%%20%1,=empty,none=,at=%40%%1f600% x-1.5 y52.1234567
n-2 v3 dD c9 t2020-01-02T00:00:00Z i0 u T x y
n3 v1 dV c0 t i0 u T x0.0000001 y-0.5
w4 v2 dV c2 t2020-01-01T00:00:00Z i7 uu Troad=yes Nn1,n3,n1
r5 v1 dV c2 t2020-01-01T00:00:00Z i7 uu Ttype=site Mn1@,w4@some%20%role,r5@x
"""


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.drop("_src", "_seq").collect()), key=lambda r: (r["type"], r["id"], r["version"]))


def test_lines_round_trip(spark, objects):
    df = objects(LINES)
    by = {(r["type"], r["id"]): r for r in rows(df)}
    assert by["n", 1]["tags"] == [{"k": "name", "v": "Straße, 1"}, {"k": "", "v": "empty"}, {"k": "none", "v": ""}, {"k": "at", "v": "@\U0001f600"}]
    assert (by["n", 1]["lon_e7"], by["n", 1]["lat_e7"], by["n", 1]["user"]) == (-15_000_000, 521_234_567, "Uschi Müller")
    assert by["n", -2]["visible"] is False and by["n", -2]["lon_e7"] is None
    assert by["n", 3]["timestamp"] is None and by["n", 3]["lon_e7"] == 1
    assert [r["ref"] for r in by["w", 4]["refs"]] == [1, 3, 1]
    assert by["r", 5]["members"][1] == {"type": "w", "ref": 4, "role": "some role"}
    written = opl.lines(df.orderBy("_seq")).collect()
    assert [r.line for r in written] == [x.strip() for x in LINES.strip().splitlines()]


def test_lines_with_locations(objects):
    df = objects("w1 v1 dV c0 t i0 u T Nn1x1.5y2,n2")
    assert [tuple(r) for r in df.first().refs] == [(1, 15_000_000, 20_000_000), (2, None, None)]
    assert opl.lines(df, locations_on_ways=True).first().line.endswith(" Nn1x1.5y2,n2xy")


XML = """<?xml version='1.0' encoding='UTF-8'?>
<osm version="0.6" upload="false" generator="made">
  <bounds minlat="1" minlon="2" maxlat="3" maxlon="4"/>
  <node id="1" version="2" timestamp="2020-01-01T00:00:00Z" uid="3" user="a&amp;b" changeset="4" lat="1.5" lon="2.25"><tag k="x" v="&quot;"/></node>
  <node id="2" lat="0" lon="0"/>
  <way id="3" version="1"><nd ref="1"/><nd ref="2"/><tag k="" v="v"/></way>
  <relation id="4" version="1"><member type="way" ref="3" role=""/></relation>
</osm>"""
CHANGES = """<osmChange version="0.6"><create><node id="9" version="1" lat="1" lon="1"/></create>
<delete><way id="3" version="2"><nd ref="1"/></way></delete><modify><node id="1" version="3" lat="5" lon="6"/></modify></osmChange>"""


def test_xml(spark, tmp_path):
    path = tmp_path / "in.osm"
    path.write_text(XML)
    found = files.read(spark, [str(path)])
    assert found.header == Header({"version": "0.6", "upload": "false", "generator": "made"}, ((20_000_000, 10_000_000, 40_000_000, 30_000_000),))
    by = {(r["type"], r["id"]): r for r in rows(found.df)}
    assert by["n", 1]["tags"] == [{"k": "x", "v": '"'}] and by["n", 1]["user"] == "a&b" and by["n", 1]["lat_e7"] == 15_000_000
    assert by["n", 2]["version"] == 0 and by["n", 2]["tags"] == []
    assert by["w", 3]["refs"][1]["ref"] == 2 and by["w", 3]["tags"] == [{"k": "", "v": "v"}]
    assert by["r", 4]["members"] == [{"type": "w", "ref": 3, "role": ""}]
    out = tmp_path / "out.osm"
    files.write(found, str(out))
    joined = tmp_path / "again.osm"
    files.join_parts(str(out), str(joined))
    assert rows(files.read(spark, [str(joined)]).df) == rows(found.df)
    with pytest.raises(Exception, match="already exists"):
        files.write(found, str(out))


def test_change_file(spark, tmp_path):
    path = tmp_path / "in.osc"
    path.write_text(CHANGES)
    found = files.read(spark, [str(path)])
    assert found.kind == "change"
    assert [(r.type, r.id, r.visible) for r in found.df.orderBy("_seq").collect()] == [("n", 9, True), ("w", 3, False), ("n", 1, True)]
    actions = [r.action for r in xmlfile.elements(found.df.orderBy("_seq")).collect()]
    assert actions == ["create", "delete", "modify"]


def test_xml_by_splits(spark, tmp_path):
    """Files of XML, packed or not, are read by splits that begin anywhere, in their order and with their sections."""
    things = [f'<node id="{i}" version="2" lat="{i % 7}.5" lon="1"><tag k="a" v="b{i}"/>\n</node>\n' if i % 3 else f'<way id="{i}"\n version="1"><nd ref="{i + 1}"/></way>' for i in range(1, 400)]
    (tmp_path / "in.osm").write_text('<?xml version="1.0"?>\n<osm version="0.6"><bounds minlon="1" minlat="1" maxlon="2" maxlat="2"/>\n' + "\n".join(things) + "\n</osm>")
    changes = "".join(f"<{('delete', 'modify')[i // 90 % 2]}>\n" + "\n".join(things[i : i + 90]) + f"</{('delete', 'modify')[i // 90 % 2]}>\n" for i in range(0, 399, 90))
    (tmp_path / "in.osc").write_text(f'<osmChange version="0.6">\n{changes}</osmChange>\n')
    whole = rows(xmlfile.parsed_files(spark, str(tmp_path / "in.osc"), xmlfile.parse_events))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        data, changed = xmlfile.read(spark, str(tmp_path / "in.osm")), xmlfile.read_changes(spark, str(tmp_path / "in.osc"))
        assert data.rdd.getNumPartitions() > 10 and changed.rdd.getNumPartitions() > 10
        found = changed.orderBy("_seq").collect()
        assert [(r.id, r.visible) for r in found] == [(i, (i - 1) // 90 % 2 == 1) for i in range(1, 400)]
        bare = lambda rs: sorted(({k: v for k, v in r.items() if k != "_seq"} for r in rs), key=str)
        assert bare(rows(changed)) == bare(whole)
        assert [r.id for r in data.where("type = 'w'").orderBy("_seq").collect()] == [i for i in range(1, 400) if i % 3 == 0]
        assert data.where("type = 'n'").count() == 266 and data.orderBy("_seq").first()["type"] == "n"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "cut.osc").write_text('<osmChange><create><node id="9" version="1"><tag k="a" v="b"/>')
    with pytest.raises(Exception, match="within an object"):
        xmlfile.read_changes(spark, str(tmp_path / "cut.osc")).collect()


def test_changesets(spark, tmp_path):
    path = tmp_path / "cs.osm"
    path.write_text('<osm><changeset id="1" created_at="2020-01-01T00:00:00Z" open="true" user="u" uid="2" num_changes="3"><tag k="a" v="b"/></changeset>\n<changeset id="2" created_at="2020-01-01T00:00:00Z" closed_at="2020-01-01T01:00:00Z" open="false" min_lat="1" min_lon="2" max_lat="3" max_lon="4" comments_count="5"/></osm>')
    a, b = xmlfile.read_changesets(spark, str(path)).orderBy("id").collect()
    assert a.open and a.closed_at is None and a.num_changes == 3 and a.tags[0].k == "a"
    assert not b.open and b.num_comments == 5 and b.max_lon_e7 == 40_000_000
    assert opl.changeset_lines(xmlfile.read_changesets(spark, str(path)).where("id = 2")).first().line == "c2 k0 s2020-01-01T00:00:00Z e2020-01-01T01:00:00Z d5 i0 u x2 y1 X4 Y3 T"


@pytest.mark.parametrize("compression", ["zlib", "none", "lz4"])
def test_binary_round_trip(spark, objects, tmp_path, compression):
    df = objects(LINES).orderBy("_seq")
    header = Header({"generator": "g", "sorting": "Type_then_ID"}, ((1, 2, 3, 4),))
    files.write(Dataset(df, header), str(tmp_path / "parts"), f"pbf,pbf_compression={compression}")
    files.join_parts(str(tmp_path / "parts"), str(tmp_path / "x.pbf"))
    found = files.read(spark, [str(tmp_path / "x.pbf")])
    assert rows(found.df) == rows(df)
    assert found.header.options == {"generator": "g", "sorting": "Type_then_ID"} and found.header.boxes == ((1, 2, 3, 4),)
    assert [r.id for r in found.df.orderBy("_seq").collect()] == [1, -2, 3, 4, 5]


@pytest.mark.parametrize("compression", ["zlib", "none", "lz4"])
def test_binary_by_splits(spark, objects, tmp_path, monkeypatch, compression):
    """Files whose blocks go over any number of splits, and a folder of parts, give the same rows in the same order."""
    monkeypatch.setattr(pbf, "BLOCK_OBJECTS", 12)
    text = "\n".join(f"n{i} v1 dV c{i} t2020-01-01T00:00:00Z i7 uu Tname=OSMData%0a%{i * i},k{i}=v x{i % 90}.5 y{i % 80}" for i in range(1, 120))
    df = objects(text).repartitionByRange(3, "_seq").sortWithinPartitions("_seq")
    files.write(Dataset(df), str(tmp_path / "parts"), f"pbf,pbf_compression={compression}")
    files.join_parts(str(tmp_path / "parts"), str(tmp_path / "x.pbf"))
    size = (tmp_path / "x.pbf").stat().st_size
    whole = [r["id"] for r in pbf.parse((tmp_path / "x.pbf").read_bytes())]
    assert whole == list(range(1, 120))
    for split in (size // 2 + 1, size // 9):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            for path in (tmp_path / "x.pbf", tmp_path / "parts"):
                found = pbf.read(spark, str(path))
                assert found.rdd.getNumPartitions() > 1
                assert [r.id for r in found.orderBy("_seq").collect()] == whole
                assert rows(found) == rows(df)
            assert pbf.read_header(spark, str(tmp_path / "x.pbf")).options == {"generator": "waymill"}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "cut.pbf").write_bytes((tmp_path / "x.pbf").read_bytes()[:-30])
    with pytest.raises(Exception, match="within a block"):
        pbf.read(spark, str(tmp_path / "cut.pbf")).collect()


def test_metadata_on_demand(spark, objects, tmp_path):
    df = objects(LINES).where("id = 1").coalesce(1)
    for given, expected in (("false", "n1 v0 dV c0 t i0 u T"), ("version+user", "n1 v1 dV c0 t i0 uUschi%20%Müller T")):
        files.write(Dataset(df), str(tmp_path / given), f"opl,add_metadata={given}")
        assert spark.read.text(str(tmp_path / given)).first().value.startswith(expected)
    with pytest.raises(ValueError):
        files.write(Dataset(df), str(tmp_path / "x"), "pbf,pbf_compression=bzip2")


def test_plain_binary_nodes():
    """Nodes that aren't packed, and ways with locations."""
    node = pbf._number(1, pbf._zig(-7)) + pbf._number(8, pbf._zig(15)) + pbf._number(9, pbf._zig(25))
    way = pbf._number(1, 8) + pbf._list(8, pbf._steps([3, 1])) + pbf._list(9, pbf._steps([10, 20])) + pbf._list(10, pbf._steps([30, 40]))
    content = pbf._bytes(1, pbf._bytes(1, b"")) + pbf._bytes(2, pbf._bytes(1, node) + pbf._bytes(3, way))
    a, b = pbf.parse(pbf._blob("OSMData", content, "zlib"))
    again = pbf.data_block([{**a, "id": -9, "tags": [{"k": "x", "v": ""}], "timestamp": None, "user": "me"}], dense=False)
    (c,) = pbf.parse(again)
    assert (c["id"], c["lon_e7"], c["lat_e7"], c["user"], c["tags"]) == (-9, 25, 15, "me", [{"k": "x", "v": ""}]) and again[-1] == 10
    assert (a["id"], a["lon_e7"], a["lat_e7"]) == (-7, 25, 15)
    assert b["refs"] == [{"ref": 3, "lon_e7": 30, "lat_e7": 10}, {"ref": 1, "lon_e7": 40, "lat_e7": 20}]


def test_stream_format():
    def put(n):
        return pbf._put(n)

    def signed(n):
        return put(n << 1 if n >= 0 else (-n << 1) - 1)

    def part(kind, body):
        return bytes([kind]) + put(len(body)) + body

    tag = b"\0road\0yes\0"
    author = signed(1_577_836_800) + signed(5) + b"\0" + put(9) + b"\0me\0"
    data = b"\xff" + part(0x10, signed(1) + put(2) + author + signed(10) + signed(20) + tag)
    data += part(0x10, signed(1) + put(0) + signed(1) + signed(-1) + put(1))  # the tag by reference, behind the author
    refs = signed(1) + signed(1)
    data += part(0x11, signed(5) + put(0) + put(len(refs)) + refs)
    member = signed(7) + b"\x001role\0"
    data += part(0x12, signed(1) + put(0) + put(len(member)) + member) + part(0x12, signed(1) + put(0)) + b"\xfe"
    a, b, w, r, gone = o5m.parse(data)
    assert (a["id"], a["version"], a["timestamp"], a["changeset"], a["uid"], a["user"]) == (1, 2, "2020-01-01T00:00:00Z", 5, 9, "me")
    assert a["tags"] == b["tags"] == [{"k": "road", "v": "yes"}] and (b["id"], b["lon_e7"], b["lat_e7"]) == (2, 11, 19)
    assert [x["ref"] for x in w["refs"]] == [1, 2] and w["id"] == 7
    assert r["members"] == [{"type": "w", "ref": 7, "role": "role"}] and gone["visible"] is False


def test_debug_form(objects):
    text = [r.text for r in debug.blocks(objects(LINES).orderBy("_seq")).collect()]
    assert text[2] == 'node 3 visible\n  version:   1\n  changeset: 0\n  timestamp: NOT SET\n  user:      0 ""\n  lon/lat:   0.0000001,-0.5\n'
    assert text[3].splitlines()[-6:] == ["  tags:      1", '    "road" = "yes"', "  nodes:     3 (closed)", "    0:          1", "    1:          3", "    2:          1"]
    assert 'way 4 "some role"' in text[4]
    colored = debug.blocks(objects(LINES).orderBy("_seq"), color=True).collect()
    assert colored[0].text.startswith("\x1b[1mnode 1 visible\x1b[0m\n\x1b[36m  version:   \x1b[0m1") and colored[1].text.startswith("\x1b[1;31mnode -2 deleted")
    assert [re.sub("\x1b[^m]*m", "", r.text) for r in colored] == text


@pytest.mark.parametrize(
    ("path", "encoding", "kind", "compression"),
    [("/a.b/x.osm", "xml", "data", None), ("x.osh.bz2", "xml", "history", "bz2"), ("x.osc.gz", "xml", "change", "gz"), ("x.osm.opl", "opl", "data", None), ("x.osm.pbf", "pbf", "data", None), ("x.osh.pbf", "pbf", "history", None)],
)
def test_format_of_suffix(path, encoding, kind, compression):
    form = files.resolve(path)
    assert (form.encoding, form.kind, form.compression) == (encoding, kind, {"gz": "gzip", "bz2": "bzip2"}.get(compression))


def test_format_errors():
    for path in ("-", "x.png", "x.pbf.gz"):
        with pytest.raises(ValueError):
            files.resolve(path)
    assert files.resolve("-", "opl,locations_on_ways").option("locations_on_ways") == "true"


def test_header_settings():
    header = Header({"a": "1"}).merged(["b=2", "c!", "d=x=y"], Header({"c": "3"}))
    assert header.options == {"a": "1", "b": "2", "c": "3", "d": "x=y"}
    with pytest.raises(ValueError):
        Header().merged(["=x"])


def test_id_lists(spark, tmp_path):
    (tmp_path / "ids").write_text("n1\n2 remark\nw3#x\n\nr4\n2\n")
    got = ids.read_ids(spark, str(tmp_path / "ids"), "w")
    assert sorted((r.type, r.id) for r in got.collect()) == [("n", 1), ("r", 4), ("w", 2), ("w", 3)]
    got = ids.ids_of_arguments(spark, ["n1,w2", "3;r4|5/6\t7"])
    assert sorted((r.type, r.id) for r in got.collect()) == [("n", 1), ("n", 3), ("n", 5), ("n", 6), ("n", 7), ("r", 4), ("w", 2)]
    with pytest.raises(Exception, match="Not an id"):
        ids.ids_of_arguments(spark, ["-5"]).collect()


def test_boundaries(spark, objects, tmp_path):
    ring = [[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]]
    region = boundaries.of_geojson('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [%s]}}]}' % ring)
    assert region.box == (0, 0, 20_000_000, 20_000_000) and region.polygons[0][0][1] == (20_000_000, 0)  # turned counter-clockwise
    poly = boundaries.of_poly("title\nouter\n 0 0\n 0 2\n 2 2\n 2 0\nEND\n!hole\n 0.5 0.5\n 1 0.5\n 1 1\nEND\nEND\n")
    assert len(poly.polygons) == 1 and len(poly.polygons[0]) == 2
    df = objects("n1 v1 dV T x0 y0\nn2 v1 dV T x2 y0\nn3 v1 dV T x2 y2\nn4 v1 dV T x0 y2\nw1 v1 dV T Nn1,n2,n3\nw2 v1 dV T Nn3,n4,n1\nr1 v1 dV Ttype=boundary Mw1@outer,w2@")
    assert boundaries.of_objects(df).box == (0, 0, 20_000_000, 20_000_000)
    for bad in ("[]", "{", '{"type": "Point", "coordinates": [1, 2]}', '{"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}'):
        with pytest.raises(boundaries.BoundaryError):
            boundaries.of_geojson(bad)
    for bad in ("title\nr\n 1 1\n 2 2\nEND\nEND\n", "title\n!r\n 0 0\n 1 0\n 1 1\nEND\nEND\n", "title\nr\n x y\nEND\nEND\n", "title\n"):
        with pytest.raises(boundaries.BoundaryError):
            boundaries.of_poly(bad)
    with pytest.raises(boundaries.BoundaryError):
        boundaries.of_box("3,0,1,1")
    (tmp_path / "b.poly").write_text("t\nr\n 0 0\n 0 2\n 2 2\nEND\nEND\n")
    (tmp_path / "c.json").write_text('{"directory": "out", "extracts": [{"output": "a.osm", "bbox": [1, 1, 0, 0]}, {"output": "b.osm", "polygon": {"file_name": "b.poly", "file_type": "poly"}}, {"output": "c.osm", "multipolygon": [[[[0,0],[0,2],[2,2],[0,0]]]]}]}')
    plans = boundaries.read_extract_config(spark, str(tmp_path / "c.json"))
    assert [p.output for p in plans] == ["out/a.osm", "out/b.osm", "out/c.osm"] and plans[0].region.box == (0, 0, 10_000_000, 10_000_000)


def test_columns_are_not_inferred(spark, tmp_path):
    """One tag is an array of one tag."""
    (tmp_path / "x.osm").write_text('<osm><node id="1" lat="1" lon="1"><tag k="a" v="b"/></node></osm>')
    assert xmlfile.read(spark, str(tmp_path / "x.osm")).select(F.size("tags")).first()[0] == 1

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from waymill.functions.geometry import Region, contains_points
from waymill.model import Dataset, Header, canonical_order
from waymill.operators import changes, extracting, filters, locations, merging, references, renumbering, summary


def at(day, hour=0):
    return datetime(2020, 1, day, hour, tzinfo=UTC)


HISTORY = """
n1 v1 dV t2020-01-01T00:00:00Z T x1 y1
n1 v2 dV t2020-01-03T00:00:00Z T x1 y2
n1 v4 dD t2020-01-05T00:00:00Z T
n2 v1 dV t2020-01-02T00:00:00Z T x2 y1
n2 v2 dV t2020-01-02T00:00:00Z T x2 y2
n3 v1 dV t2020-01-04T00:00:00Z T x3 y3
"""


@pytest.mark.parametrize(
    ("point", "expected"),
    [(at(1), ["n1v1"]), (at(2), ["n1v1", "n2v2"]), (at(3), ["n1v2", "n2v2"]), (at(4), ["n1v2", "n2v2", "n3v1"]), (at(6), ["n2v2", "n3v1"])],
)
def test_point_in_time(objects, ids, point, expected):
    assert ids(filters.time_filter(objects(HISTORY), point), version=True) == expected


def test_time_range(objects, ids):
    h = objects(HISTORY)
    assert ids(filters.time_filter(h, at(2), at(5)), version=True) == ["n1v1", "n1v2", "n2v1", "n2v2", "n3v1"]
    assert ids(filters.time_filter(h, at(5), at(9)), version=True) == ["n1v4", "n2v2", "n3v1"]


# Seven nodes on a line, ways inside and out, relations over them and over each other.
MAP = """
n1 v1 dV T x0.5 y0.5
n2 v1 dV T x1 y0.5
n3 v1 dV T x1.5 y0.5
n4 v1 dV T x2 y0.5
n5 v1 dV T x2.5 y0.5
n6 v1 dV Tname=x x3 y0.5
n7 v1 dV T x3.5 y0.5
w10 v1 dV Troad=a Nn1,n2,n4
w11 v1 dV Troad=b Nn5,n6
r20 v1 dV Ttype=route Mn1@
r21 v1 dV Ttype=route Mn7@
r22 v1 dV Ttype=multipolygon Mw10@outer,w11@outer
r23 v1 dV Ttype=site Mr20@
r24 v1 dV Ttype=site Mr23@
r25 v1 dV Ttype=site Mr21@,w11@
"""
BOX = {"box": Region.of_box((0, 0), (15_000_000, 100_000_000))}


@pytest.mark.parametrize(
    ("strategy", "options", "expected"),
    [
        ("simple", {}, "n1 n2 n3 r20 r22 w10"),
        ("complete_ways", {}, "n1 n2 n3 n4 r20 r22 r23 r24 w10"),
        ("complete_ways", {"relations": False}, "n1 n2 n3 n4 w10"),
        ("smart", {}, "n1 n2 n3 n4 n5 n6 r20 r22 r23 r24 w10 w11"),
        ("smart", {"types": ["route"]}, "n1 n2 n3 n4 r20 r22 r23 r24 w10"),
        ("smart", {"types": ["route"], "complete_percent": 50}, "n1 n2 n3 n4 n5 n6 r20 r22 r23 r24 w10 w11"),
        ("smart", {"complete_tags": ["type=route"]}, "n1 n2 n3 n4 r20 r22 r23 r24 w10"),
    ],
)
def test_extract_strategies(objects, ids, strategy, options, expected):
    found = extracting.extract(objects(MAP), BOX, strategy, **options)
    assert ids(found) == expected.split()


def test_strategies_hold_each_other(objects, ids):
    df = objects(MAP)
    simple, ways, smart = (set(ids(extracting.extract(df, BOX, s))) for s in ("simple", "complete_ways", "smart"))
    assert simple <= ways <= smart


def test_extract_of_history(objects, ids):
    df = objects("n1 v1 dV T x0.5 y0.5\nn1 v2 dV T x9 y9\nn2 v1 dV T x9 y9\nw1 v1 dV T Nn1\nw1 v2 dV T Nn2")
    assert ids(extracting.extract(df, BOX, history=True), version=True) == ["n1v1", "n1v2", "n2v1", "w1v1", "w1v2"]
    with pytest.raises(ValueError):
        extracting.extract(df, BOX, "smart", history=True)
    with pytest.raises(ValueError):
        extracting.extract(df, BOX, "other")


def test_polygon_edges(spark):
    """Corners are inside, edges by their direction; expression and array form agree."""
    square = [(0, 0), (100, 0), (100, 100), (0, 100)]
    hole = [(40, 40), (60, 40), (60, 60), (40, 60)]
    region = Region.of_polygons([[square, hole]])
    points = [(x, y) for x in (-1, 0, 1, 40, 50, 60, 99, 100, 101) for y in (-1, 0, 1, 40, 50, 60, 99, 100, 101)]
    df = spark.createDataFrame(points, "x int, y int")
    by_column = {(r.x, r.y): r.inside for r in df.select("x", "y", region.contains(F.col("x"), F.col("y")).alias("inside")).collect()}
    import numpy as np

    xs, ys = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    box = (xs >= 0) & (xs <= 100) & (ys >= 0) & (ys <= 100)
    by_array = dict(zip(points, (contains_points(region.edges(), xs, ys) & box).tolist(), strict=True))
    assert by_column == by_array
    assert by_array[0, 0] and by_array[100, 100] and by_array[40, 40] and by_array[1, 50]
    assert not by_array[50, 50] and not by_array[101, 50]
    many = Region.of_polygons([[[(int(1e6 * np.cos(a)), int(1e6 * np.sin(a))) for a in np.linspace(0, 6.28, 200)]]])
    assert spark.range(1).select(many.contains(F.lit(0), F.lit(10)), many.contains(F.lit(999_000), F.lit(500_000))).first()[:] == (True, False)


def test_extracts_at_once_and_limits(objects):
    far = Region.of_box((30_000_000, 0), (40_000_000, 10_000_000))
    found = extracting.extract_ids(objects(MAP), {"a": BOX["box"], "b": far}, "simple").where("type = 'n'")
    assert sorted((r.extract, r.id) for r in found.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 6), ("b", 7)]
    with pytest.raises(ValueError):
        extracting.extract_ids(objects(MAP), {str(i): far for i in range(501)})


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert sorted(r.id for r in references.closure(spark.createDataFrame([(1,)], "id long"), edges).collect()) == [1, 2, 3]


SITE = "n1 v1 dV T x1 y1\nn2 v1 dV T x1 y1\nn3 v1 dV Ta=b x1 y1\nw1 v1 dV T Nn1,n2\nr1 v1 dV T Mw1@,r2@\nr2 v1 dV T Mr1@,n3@\nr3 v1 dV Tsite=yes Mr1@"


def id_set(spark, *names):
    return spark.createDataFrame([(n[0], int(n[1:])) for n in names], "type string, id long")


def test_get_ids(spark, objects, ids):
    df = objects(SITE)
    assert ids(references.get_ids(df, id_set(spark, "w1", "n9"))) == ["w1"]
    assert ids(references.get_ids(df, id_set(spark, "r3"), add_referenced=True)) == ["n1", "n2", "n3", "r1", "r2", "r3", "w1"]
    assert ids(references.missing_ids(df, id_set(spark, "w1", "n9"))) == ["n9"]
    bare = references.get_ids(df, id_set(spark, "r2"), add_referenced=True, remove_tags=True)
    assert bare.where("size(tags) > 0").count() == 0
    twice = objects("n1 v1 dV T x1 y1\nn1 v2 dV T x1 y1\nw1 v1 dV T Nn1")
    assert ids(references.get_ids(twice, id_set(spark, "w1"), add_referenced=True), version=True) == ["n1v1", "w1v1"]
    assert ids(references.get_ids(twice, id_set(spark, "w1"), add_referenced=True, history=True), version=True) == ["n1v1", "n1v2", "w1v1"]
    assert ids(references.get_ids(twice, id_set(spark, "n1")), version=True) == ["n1v1", "n1v2"]
    negative = objects("n-1 v1 dV T x1 y1\nn2 v1 dV T x1 y1")
    assert ids(references.remove_ids(negative, id_set(spark, "n1"))) == ["n2"]


def test_get_parents(spark, objects, ids):
    df = objects(SITE)
    assert ids(references.get_parents(df, id_set(spark, "n1", "r1"))) == ["r2", "r3", "w1"]
    assert ids(references.get_parents(df, id_set(spark, "n1"), add_self=True)) == ["n1", "w1"]


def test_tags_filter(objects, ids):
    df = objects(SITE)
    assert ids(filters.tags_filter(df, ["r/site"])) == ["n1", "n2", "n3", "r1", "r2", "r3", "w1"]
    assert ids(filters.tags_filter(df, ["r/site"], add_referenced=False)) == ["r3"]
    # Only nodes have a rule, and all others fit the inverse of it.
    assert ids(filters.tags_filter(df, ["n/a=b"], invert=True, add_referenced=False)) == ["n1", "n2", "r1", "r2", "r3", "w1"]
    bare = filters.tags_filter(df, ["r/site"], remove_tags=True)
    assert [r.id for r in bare.where("size(tags) > 0").collect()] == [3]


def test_check_refs(objects):
    df = objects("n1 v1 dV T x1 y1\nw1 v1 dV T Nn1,n2,n2\nw2 v1 dV T Nn3\nr1 v1 dV T Mn9@,n9@,w9@,r9@,r2@\nr2 v1 dV T Mn9@,r9@")
    got = references.check_refs(df, relations=True).first().asDict()
    assert got == {"nodes": 1, "ways": 2, "relations": 2, "missing_nodes_in_ways": 3, "missing_nodes_in_relations": 1, "missing_ways_in_relations": 1, "missing_relations_in_relations": 2}
    lines = sorted(r.line for r in references.missing_ref_lines(df).collect())
    assert lines == ["n2 in w1", "n3 in w2", "n9 in r1", "r9 in r1", "r9 in r2", "w9 in r1"]
    assert references.check_refs(objects(SITE), relations=True).first().missing_nodes_in_ways == 0


def test_canonical_order(objects):
    df = objects("r1 v1 dV T M\nw-2 v1 dV T N\nn2 v2 dV T x1 y1\nn2 v1 dV T x1 y1\nn-3 v1 dV T x1 y1\nn-1 v1 dV T x1 y1\nn0 v1 dV T x1 y1\nn1 v1 dV T x1 y1")
    names = [f"{r.type}{r.id}v{r.version}" for r in merging.sort_objects([df]).collect()]
    assert names == ["n0v1", "n-1v1", "n-3v1", "n1v1", "n2v1", "n2v2", "w-2v1", "r1v1"]
    facts = summary.order_facts(df).first()
    assert facts.ordered is False and facts.multiple_versions is None
    again = merging.sort_objects([df]).withColumn("_seq", F.monotonically_increasing_id())
    assert tuple(summary.order_facts(again).first()) == (True, True)
    assert len(canonical_order()) == 7


def test_sorted_header(objects):
    df = objects("n1 v1 dV T x1 y1")
    out = merging.sort_datasets([Dataset(df, Header({"a": "b"}, ((0, 0, 1, 1),))), Dataset(df, Header({}, ((-5, 2, 3, 4),)))])
    assert out.header == Header({"a": "b", "sorting": "Type_then_ID"}, ((-5, 0, 3, 4),)) and out.df.count() == 2


def test_merge(objects, ids):
    a, b = objects("n1 v1 dV Ta=1 x1 y1\nn2 v1 dV T x1 y1"), objects("n1 v1 dV Ta=2 x1 y1\nn1 v2 dV T x1 y1")
    out = merging.merge([a, b])
    assert ids(out, version=True) == ["n1v1", "n1v2", "n2v1"]
    assert out.where("id = 1 and version = 1").first().tags[0].v == "2"
    assert ids(merging.merge([a, a]), version=True) == ids(a, version=True)
    assert merging.merge([objects("n1 v1 dV T x1 y1\nn1 v1 dV T x1 y1")]).count() == 2


@pytest.mark.parametrize(
    ("text", "kind"),
    [("w1 v1 dV T N\nn1 v1 dV T x1 y1", "type"), ("n2 v1 dV T x1 y1\nn1 v1 dV T x1 y1", "id"), ("n1 v2 dV T x1 y1\nn1 v1 dV T x1 y1", "version"), ("n1 v1 dV T x1 y1\nn1 v1 dV T x1 y1", "same version")],
)
def test_order_errors(objects, text, kind):
    assert [(r.kind, r["count"]) for r in merging.order_errors(objects(text)).collect()] == [(kind, 1)]
    assert merging.order_errors(objects(MAP)).isEmpty()


def test_merge_changes(objects, ids):
    a, b = objects("n1 v1 dV T x1 y1\nn1 v3 dD T"), objects("n1 v2 dV T x1 y1\nn2 v1 dV T x1 y1")
    assert merging.merge_changes([a, b]).count() == 4
    last = merging.merge_changes([a, b], simplify=True)
    assert ids(last, version=True) == ["n1v3", "n2v1"] and not last.where("id = 1").first().visible


DATA = "n1 v1 dV T x1 y1\nn2 v1 dV T x1 y1\nw2 v1 dV Ta=b Nn1,n2\nr3 v1 dV T Mw2@"
CHANGE = "n1 v2 dV Tx=y x5 y5\nn2 v2 dD T\nw9 v1 dV T Nn1\nw2 v2 dV Ta=c Nn1"


def test_apply_changes(objects, ids):
    out = changes.apply_changes(objects(DATA), [objects(CHANGE)])
    assert ids(out, version=True) == ["n1v2", "r3v1", "w2v2", "w9v1"]  # way 2 and node 2 have one id


def test_apply_and_derive_are_inverse(objects):
    old, new = objects(DATA), changes.apply_changes(objects(DATA), [objects(CHANGE)])
    derived = changes.derive_changes(old, new, increment_version=True)
    assert changes.identical(changes.diff(changes.apply_changes(old, [derived]), new))
    gone = derived.where("not visible").first()
    assert (gone.type, gone.id, gone.version, gone.tags, gone.lon_e7) == ("n", 2, 2, [], None)
    kept = changes.derive_changes(old, objects("n1 v1 dV T x1 y1"), keep_details=True, update_timestamp=F.lit("2021-01-01 00:00:00"))
    assert kept.where("type = 'w'").first().tags[0].v == "b" and kept.where("timestamp is null").isEmpty()


def test_history_changes(objects, ids):
    h = objects("n1 v1 dV t2020-01-01T00:00:00Z Ta=1 x1 y1\nn1 v2 dV t2020-01-02T00:00:00Z T x1 y1")
    c = objects("n1 v1 dV t2020-01-09T00:00:00Z Ta=2 x1 y1\nn1 v3 dV t2020-01-03T00:00:00Z T x1 y1")
    assert ids(changes.apply_changes_history(h, [c]), version=True) == ["n1v1", "n1v1", "n1v2", "n1v3"]
    redacted = changes.apply_changes_history(h, [c], redact=True)
    assert ids(redacted, version=True) == ["n1v1", "n1v2", "n1v3"] and redacted.where("version = 1").first().tags[0].v == "2"


def test_changes_with_locations(objects):
    low = objects("n1 v1 dV T x1 y1\nw1 v1 dV T Nn1x1y1,n2x2y2,n3x3y3")
    out = changes.apply_changes_locations(low, [objects("n1 v2 dV T x9 y9\nn3 v1 dV T x8 y8")])
    assert [tuple(r) for r in out.where("type = 'w'").first().refs] == [(1, 90_000_000, 90_000_000), (2, 20_000_000, 20_000_000), (3, 80_000_000, 80_000_000)]


def test_diff(objects):
    a = objects("n1 v1 dV c1 i1 ua T x1 y1\nn2 v1 dV T x1 y1\nn3 v1 dV Ta=b,c=d x1 y1\nn4 v1 dV c1 T x1 y1")
    b = objects("n1 v1 dV c1 i1 ub T x1 y1\nn2 v2 dV T x1 y1\nn3 v1 dV Tc=d,a=b x1 y1\nn4 v1 dV c2 T x1 y1")
    status = {(r.id, r.version): r.status for r in changes.diff(a, b).collect()}
    assert status == {(1, 1): "*", (2, 1): "-", (2, 2): "+", (3, 1): "*", (4, 1): "*"}
    status = {(r.id, r.version): r.status for r in changes.diff(a, b, ignore=("user", "changeset")).collect()}
    assert status == {(1, 1): " ", (2, 1): "-", (2, 2): "+", (3, 1): "*", (4, 1): " "}  # the order of tags matters
    assert tuple(changes.diff_summary(changes.diff(a, b)).first()) == (1, 1, 0, 3)
    assert changes.identical(changes.diff(a, a)) and not changes.identical(changes.diff(a, b))
    assert {r.line for r in changes.diff_lines(changes.diff(a, b)).collect()} >= {"-n2 v1", "+n2 v2", "*n1 v1"}
    assert changes.diff(a, b, keep_rows=True).where("status = '*'").first().new.tags is not None


def test_renumber(objects, ids):
    df = objects("n-9 v1 dV T x1 y1\nn7 v1 dV T x1 y1\nw5 v1 dV T Nn7,n99,n-9\nr8 v1 dV T Mn7@,w5@,w77@,r8@a,n55@")
    mapping = renumbering.renumber_map(df)
    assert sorted((r.type, r.old_id, r.new_id) for r in mapping.collect()) == [("n", -9, 1), ("n", 7, 2), ("n", 55, 4), ("n", 99, 3), ("r", 8, 1), ("w", 5, 1), ("w", 77, 2)]
    out = {r.type + str(r.id): r for r in renumbering.renumber(df, mapping).collect()}
    assert [r.ref for r in out["w1"].refs] == [2, 3, 1]
    assert [(m.type, m.ref, m.role) for m in out["r1"].members] == [("n", 2, ""), ("w", 1, ""), ("w", 2, ""), ("r", 1, "a"), ("n", 4, "")]
    down = renumbering.renumber_map(df, {"n": 0, "w": 3, "r": -3})
    assert sorted((r.type, r.new_id) for r in down.collect()) == [("n", 1), ("n", 2), ("n", 3), ("n", 4), ("r", -3), ("w", 3), ("w", 4)]
    later = renumbering.renumber_map(objects("n7 v2 dV T x1 y1\nn100 v1 dV T x1 y1"), types="n", before=mapping.where("type = 'n'"))
    assert sorted((r.old_id, r.new_id) for r in later.collect()) == [(-9, 1), (7, 2), (55, 4), (99, 3), (100, 5)]
    nodes_only = renumbering.renumber(df, renumbering.renumber_map(df, types="n"))
    assert ids(nodes_only) == ["n1", "n2", "r8", "w5"]


def test_add_locations(objects, ids):
    df = objects("n1 v1 dV T x1 y1\nn-2 v1 dV Ta=b x2 y2\nn3 v1 dV T x3 y3\nw1 v1 dV T Nn1,n-2\nr1 v1 dV T Mn3@")
    out = locations.add_locations(df)
    assert ids(out) == ["n-2", "r1", "w1"]
    assert [tuple(r) for r in out.where("type = 'w'").first().refs] == [(1, 10_000_000, 10_000_000), (-2, 20_000_000, 20_000_000)]
    assert ids(locations.add_locations(df, keep_member_nodes=True)) == ["n-2", "n3", "r1", "w1"]
    assert locations.add_locations(df, keep_untagged=True).count() == 5
    broken = objects("n1 v1 dV T x1 y1\nw1 v1 dV T Nn1,n9")
    with pytest.raises(Exception, match="No location for a node of way 1"):
        locations.add_locations(broken).collect()
    assert locations.add_locations(broken, ignore_missing=True).first().refs[1].lon_e7 is None


def test_locations_index(spark, objects, tmp_path):
    index = locations.locations_index(objects("n1 v1 dV T x1 y1\nn-5 v1 dV T x2 y2"))
    locations.write_index(index, str(tmp_path / "index"))
    index = locations.read_index(spark, str(tmp_path / "index"))
    assert locations.location_of(index, 5) == (20_000_000, 20_000_000)
    with pytest.raises(KeyError):
        locations.location_of(index, 2)
    newer = locations.locations_index(objects("n5 v1 dV T x3 y3"), before=index)
    assert [(r.id, r.lon_e7) for r in locations.dump_index(newer).collect()] == [(1, 10_000_000), (5, 30_000_000)]


def test_tags_count(objects):
    df = objects('n1 v1 dV Ta=1,b=2 x1 y1\nw1 v1 dV Ta=1,c=x%22%y N\nr1 v1 dV Ta=2 M')
    count = lambda *a, **k: [tuple(r) for r in summary.sorted_counts(summary.tags_count(df, *a, **k)).collect()]
    assert count() == [(3, "a", None), (1, "b", None), (1, "c", None)]
    assert count(["a", "a=*"]) == [(3, "a", None), (2, "a", "1"), (1, "a", "2")]
    assert count(["w/a"]) == [(1, "a", None)] and count(None, 2) == [(3, "a", None)] and count(None, None, 1)[0] == (1, "b", None)
    names = [r.key for r in summary.sorted_counts(summary.tags_count(df), "name-desc").collect()]
    assert names == ["c", "b", "a"]
    assert summary.count_lines(summary.tags_count(df, ["c=*"])).first().line == '1\t"c"\t"x""y"'
    with pytest.raises(ValueError):
        summary.sorted_counts(summary.tags_count(df), "size")


def test_file_facts(objects):
    df = objects("n1 v1 dV c1 t2020-01-01T00:00:00Z i1 ua T x1 y-1\nn-5 v1 dV c0 t2020-01-02T00:00:00Z i0 u T x-2 y3\nw3 v0 dV T N")
    counts = {r.type: (r["count"], r.min_id, r.max_id) for r in summary.file_counts(df).collect()}
    assert counts == {"n": (2, -5, 1), "w": (1, 3, 3), "r": (0, 0, 0)}
    facts = summary.file_facts(df).first()
    assert (facts.min_lon_e7, facts.max_lon_e7, facts.min_lat_e7, facts.max_lat_e7) == (-20_000_000, 10_000_000, -10_000_000, 30_000_000)
    assert facts.some_user and not facts.all_user and not facts.all_version
    assert summary.fingerprint(df).first() == summary.fingerprint(df.orderBy(F.col("id").desc())).first()


def test_clean(objects):
    row = merging.clean(objects("n1 v5 dV c9 t2020-01-01T00:00:00Z i1 ua T x1 y1"), ["version", "user", "timestamp"]).first()
    assert (row.version, row.user, row.timestamp, row.changeset) == (0, "", None, 9)
    with pytest.raises(ValueError):
        merging.clean(objects("n1 v1 dV T x1 y1"), ["tags"])

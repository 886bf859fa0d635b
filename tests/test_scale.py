"""What grows with the data must not end in one task, and is moved once and narrow."""

import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from waymill import scratch
from waymill.operators import changes as ch
from waymill.operators import exporting as ex
from waymill.operators import locations as lo
from waymill.operators import references as rf
from waymill.operators import renumbering as rn
from waymill.plans import tables as t
from waymill.sources import pbf

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stream_batches_are_written_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        entry.queries()["replication_stream"](spark, DATA).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = [p for p in scratch._WRITTEN[spark.sparkContext.applicationId] if "/stream-" in p][-1]
    assert len(glob.glob(f"{folder}/part-*")) > 2


def test_check_refs_is_one_aggregate(spark, objects):
    found = rf.check_refs(objects("n1\nn1 v2\nw5 Nn1,n2,n2,n3\nr7 Mn2@,n2@,w5@,w6@,r8@,r8@,r7@\nr9 Mn2@,w6@"), relations=True)
    assert found.first().asDict() == {"nodes": 2, "ways": 1, "relations": 2, "missing_nodes_in_ways": 3, "missing_nodes_in_relations": 1, "missing_ways_in_relations": 1, "missing_relations_in_relations": 2}
    assert "Join" not in plan(found) and "Expand" not in plan(found)
    assert rf.check_refs(objects("r7 Mn2@")).first().missing_nodes_in_ways == 0


def test_rows_that_are_there_twice_keep_their_lists(spark, objects):
    rows = objects("n1 x1 y2\nn2 x3 y4\nw5 Nn2,n1,n2\nr7 Mn1@a,w5@b")
    twice = rows.unionByName(rows)
    ways = lo.refreshed_locations(twice).where("type = 'w'").select(F.transform("refs", lambda r: r["lon_e7"]).alias("x")).collect()
    assert [r.x for r in ways] == [[30_000_000, 10_000_000, 30_000_000]] * 2
    new = rn.renumber(twice, rn.renumber_map(rows, {"n": 10})).where("type <> 'n'").select("type", "refs.ref", "members").collect()
    assert sorted((r.type, r.ref, [(m.type, m.ref, m.role) for m in r.members or ()]) for r in new) == [("r", None, [("n", 10, "a"), ("w", 1, "b")])] * 2 + [("w", [11, 10, 11], [])] * 2


def test_ways_are_located_once(spark, objects):
    rows = objects("n1 x1 y1\nn2 x2 y1\nn3 x1 y2\nw5 Ta=b Nn1,n2,n3,n1\nw6 Ta=b Nn1\nr7 Ttype=multipolygon Mw5@")
    made, errors = ex.features(rows)
    assert "posexplode(refs" not in plan(errors) and "posexplode(refs" not in plan(made)
    assert sorted((r.type, r.id) for r in errors.collect()) == [("w", 6)]


def written(spark, name):
    return [p for p in scratch._WRITTEN.get(spark.sparkContext.applicationId, []) if f"/{name}-" in p]


AREAS = "n1 x1 y1\nn2 x2 y1\nn3 x1 y2\nw5 Nn1,n2,n3,n1\nw6 Ta=b Nn1,n2,n3,n1\nw8 Ta=b Nn1\nr7 Ttype=multipolygon,a=b Mw5@\nr9 Ttype=route Mw6@"


def test_only_ways_of_areas_are_located_for_relations(spark, objects):
    every = len(written(spark, "located-ways"))
    made, errors = ex.features(objects(AREAS), ex.ExportConfig(object_types=("r",)))
    assert len(written(spark, "located-ways")) == every
    assert [r.id for r in spark.read.parquet(written(spark, "member-ways")[-1]).collect()] == [5]
    assert [(r.feature_id, len(r.area[0][0])) for r in made.collect()] == [("a15", 4)] and errors.count() == 0
    both = ex.features(objects(AREAS))[0].where("type = 'r'").collect()
    assert both == made.collect()


def test_ways_alone_are_neither_written_nor_asked_twice(spark, objects):
    every = len(written(spark, "located-ways"))
    made, errors = ex.features(objects(AREAS), ex.ExportConfig(object_types=("w",)))
    assert len(written(spark, "located-ways")) == every
    assert plan(made).count("posexplode(") == 1 and "Union" not in plan(made)
    both = ex.features(objects(AREAS))
    assert sorted(made.collect()) == sorted(both[0].where("type = 'w'").collect()) and len(made.collect()) == 2
    assert [(r.type, r.id) for r in errors.collect()] == [("w", 8)]
    with pytest.raises(ValueError):
        ex.features(objects(AREAS), ex.ExportConfig(geometry_types=("line",)))


def test_places_go_to_the_locations_as_plain_numbers(spark, objects):
    rows = objects("n1 x-180 y-90\nn2 x180 y90\nn3 x-0.0000001 y0.0000001\nw5 Nn1,n2x3y4,n3,n4x5y-6,n4x7y")
    found = lo.refreshed_locations(rows).where("type = 'w'").first().refs
    assert [(r.ref, r.lon_e7, r.lat_e7) for r in found] == [(1, -1_800_000_000, -900_000_000), (2, 1_800_000_000, 900_000_000), (3, -1, 1), (4, 50_000_000, -60_000_000), (4, 70_000_000, None)]
    unset = rows.withColumns({"version": F.lit(None).cast("int"), "_src": F.lit(None).cast("int"), "_seq": F.lit(None).cast("long")})
    assert lo.refreshed_locations(unset).where("type = 'w'").first().refs == found
    dealt = [x for x in lo.refreshed_locations(rows)._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in x]
    assert dealt and not any("struct" in x for x in dealt)


def test_refs_are_put_together_once_for_a_way(spark, objects):
    made, _ = ex.features(objects(AREAS), ex.ExportConfig(object_types=("w",)))
    conditions = [x for x in plan(made.select("feature_id", "geometry_type")).splitlines() if x.strip(" :+-").startswith("Filter")]
    assert conditions and not any("located" in x for x in conditions)


def test_lines_are_read_without_a_function_for_each_ref(spark, objects):
    rows = objects("w1 v2 dV c3 t2020-02-29T01:02:03Z i4 ua%20%b Tk%3d%=v,=,x Nn1,,n-2,n3\nw2  N\nw3 t Nn1xy,n2x1y2 v1 v7\nw4 v5 t2020-02-30T00:00:00Z\nr5 uN t1999 Mw1@a%40%b,n2@,,r-3@c\nn6 x1.5 y2")
    assert "translate" not in plan(rows) and "regexp_replace" not in plan(rows) and "lambda f" not in plan(rows)
    a, b, c, d, e, f = rows.orderBy("id").collect()
    assert (a.version, a.changeset, str(a.timestamp), a.uid, a.user, a.tags) == (2, 3, "2020-02-29 01:02:03", 4, "a b", [("k=", "v"), ("", ""), ("x", "")])
    assert [r.ref for r in a.refs] == [1, -2, 3] and b.refs == [] and b.version == 0 and d.refs == [] and d.timestamp is None
    assert [tuple(r) for r in c.refs] == [(1, None, None), (2, 10_000_000, 20_000_000)] and c.version == 1 and c.timestamp is None
    assert [tuple(m) for m in e.members] == [("w", 1, "a@b"), ("n", 2, ""), ("r", -3, "c")] and (e.user, e.timestamp) == ("N", None)
    assert f.lat_e7 == 20_000_000 and f.refs is None


@pytest.mark.parametrize("column", ["l_extendedprice", "l_shipdate", "l_suppkey"])
def test_ways_carry_only_what_orders_them(spark, column):
    assert column not in plan(t.ways(spark, DATA)).split("Relation")[0].replace("\n", "")


def test_changed_ways_are_chosen_once(spark, objects):
    rows = objects("n1 x1 y1\nn2 x2 y1\nw5 Ta=b Nn1,n2")
    out = ch.apply_changes_locations(rows, [rows.where("type = 'n'")])
    assert "row_number" not in plan(out.where("type = 'w'")) and out.count() == 3


def test_small_numbers_of_blocks_are_read_at_once(monkeypatch):
    values = [0, 1, 127, 128, 300, (1 << 64) - 1, 5]
    data = b"".join(map(pbf._put, values))
    assert pbf._packed(data) == values and pbf._packed(b"\x01\x02") == [1, 2]
    with pytest.raises(IndexError):
        pbf._packed(data + b"\x80")
    calls = []
    slow = pbf._varint
    monkeypatch.setattr(pbf, "_varint", lambda *a: calls.append(1) or slow(*a))
    way = {"type": "w", "id": 7, "version": 1, "visible": True, "timestamp": None, "changeset": 0, "uid": 3, "user": "", "tags": [{"k": "a", "v": "b"}], "refs": [{"ref": n, "lon_e7": None, "lat_e7": None} for n in range(50)]}
    found = list(pbf.parse(pbf.data_block([way] * 100)))
    assert [r["ref"] for r in found[99]["refs"]] == list(range(50)) and len(calls) < 100

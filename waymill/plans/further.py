"""More queries over map data and their SQL: sorting, checks, export rules, extracts with options, files and streams."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.geometry import Region
from waymill.functions.tags import read_expressions
from waymill.model import Dataset
from waymill.operators import changes as ch
from waymill.operators import exporting as ex
from waymill.operators import extracting as xt
from waymill.operators import filters as fl
from waymill.operators import locations as lo
from waymill.operators import merging as mg
from waymill.operators import references as rf
from waymill.operators import renumbering as rn
from waymill.operators import summary as sm
from waymill.plans import tables as t
from waymill.plans.queries import _ALL_TAGS, _BOX, _CHANGESETS, _CLOSED_ID_SQL, _ids, _IN_BOX, _LAT, _LATER, _LON, _sets, _WITH_CHANGES, query
from waymill.plans.tables import flat
from waymill.scratch import materialise, numbered, scratch_path
from waymill.sources import boundaries, files, ids, xmlfile
from waymill.streaming import replication


def _in_order(rows: DataFrame, name: str = "position") -> DataFrame:
    """Rows with their number in the order that they come in."""
    placed = materialise(rows.withColumn("__place", F.monotonically_increasing_id()), "in-order")
    return numbered(placed, [F.col("__place")], name).drop("__place")


# --- order ----------------------------------------------------------------------------------------


@query(""", rows AS (SELECT 'w' AS type, CASE WHEN id % 3 = 0 THEN -id ELSE id END AS id, 1 AS version FROM ways UNION ALL SELECT 'n', id, 1 FROM nodes)
  SELECT *, row_number() OVER (ORDER BY CASE type WHEN 'n' THEN 0 ELSE 1 END, CASE WHEN id > 0 THEN 1 ELSE 0 END, abs(id), version) AS position FROM rows""")
def sort_simple(spark, sf_dir):
    ways = t.ways(spark, sf_dir).withColumn("id", F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id")))
    return _in_order(mg.sort_objects([ways, t.nodes(spark, sf_dir)]).select("type", "id", "version"))


def _inputs(spark, sf_dir) -> dict[str, DataFrame]:
    """Objects as they are; ways out of order; versions in order; versions in the order of their time."""
    history = t.history(spark, sf_dir)
    return {
        "sorted": t.objects(spark, sf_dir),
        "shuffled": t.ways(spark, sf_dir).withColumn("_seq", (F.col("id") * 7919) % 104_729 * 10_000_000 + F.col("id")),
        "versions": history.withColumn("_seq", F.col("id") * 1_000_000 + F.col("version")),
        "events": history,
        "twice": history.withColumns({"version": F.lit(1), "_seq": F.col("id") * 1_000_000 + F.col("version")}),
    }


_ORDERED = """
, vs AS (SELECT user_id + 1 AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_id FROM events),
inputs AS (
  SELECT 'sorted' AS input, CASE type WHEN 'n' THEN 0 WHEN 'w' THEN 1 ELSE 2 END AS kind, id, 1 AS version, CASE type WHEN 'n' THEN 0 WHEN 'w' THEN 1000000000000 ELSE 2000000000000 END + id AS seq FROM objs
  UNION ALL SELECT 'shuffled', 1, id, 1, (id * 7919) % 104729 * 10000000 + id FROM ways
  UNION ALL SELECT 'versions', 0, id, version, id * 1000000 + version FROM vs
  UNION ALL SELECT 'events', 0, id, version, event_id FROM vs
  UNION ALL SELECT 'twice', 0, id, 1, id * 1000000 + version FROM vs),
steps AS (SELECT *, lag(kind) OVER w AS kind0, lag(id) OVER w AS id0, lag(version) OVER w AS version0 FROM inputs WINDOW w AS (PARTITION BY input ORDER BY seq)),
judged AS (SELECT *, CASE WHEN kind0 IS NULL THEN NULL WHEN kind0 <> kind THEN CASE WHEN kind0 > kind THEN 'type' END WHEN id0 <> id THEN CASE WHEN id0 > id THEN 'id' END
  WHEN version0 > version THEN 'version' WHEN version0 = version THEN 'same version' END AS error, kind0 = kind AND id0 = id AS again FROM steps) """


@query(_ORDERED + """, facts AS (SELECT input, count(*) FILTER (error IN ('type', 'id', 'version')) = 0 AS ordered, coalesce(bool_or(again), false) AS several FROM judged GROUP BY input)
  SELECT input, ordered, CASE WHEN ordered THEN several END AS multiple_versions FROM facts""")
def fileinfo_order_facts(spark, sf_dir):
    out = None
    for name, df in _inputs(spark, sf_dir).items():
        facts = sm.order_facts(df).select(F.lit(name).alias("input"), "ordered", "multiple_versions")
        out = facts if out is None else out.unionByName(facts)
    return out


@query(_ORDERED + "SELECT input, error AS kind, count(*) AS count FROM judged WHERE error IS NOT NULL GROUP BY input, error")
def merge_order_errors(spark, sf_dir):
    out = None
    for name, df in _inputs(spark, sf_dir).items():
        errors = mg.order_errors(df).select(F.lit(name).alias("input"), "kind", "count")
        out = errors if out is None else out.unionByName(errors)
    return out


def _sorted_counts(by: str, sql: str) -> None:
    def run(spark, sf_dir):
        return _in_order(sm.sorted_counts(sm.tags_count(t.objects(spark, sf_dir), ["*", "type=*"]), by))

    run.__name__ = f"tags_count_sorted_{by.replace('-', '_')}"
    query(_ALL_TAGS + f""", counts AS (SELECT count(*) AS count, k AS key, NULL::VARCHAR AS value FROM tags GROUP BY k UNION ALL SELECT count(*), k, v FROM tags WHERE k = 'type' GROUP BY k, v)
  SELECT *, row_number() OVER (ORDER BY {sql}) AS position FROM counts""")(run)


_sorted_counts("count-desc", "count DESC, key, value NULLS FIRST")
_sorted_counts("count-asc", "count, key, value NULLS FIRST")
_sorted_counts("name-asc", "key, value NULLS FIRST")
_sorted_counts("name-desc", "key DESC, value DESC NULLS LAST")


# --- references, changesets, ids ------------------------------------------------------------------


@query(_CLOSED_ID_SQL + " SELECT o.type, o.id, o.version, CASE WHEN o.id IN (SELECT id FROM ids i WHERE i.type = o.type) THEN o.tags ELSE '' END AS tags, o.refs FROM objs o SEMI JOIN every USING (type, id)")
def getid_remove_tags(spark, sf_dir):
    return flat(rf.get_ids(t.stored(spark, sf_dir), _ids(spark, sf_dir), add_referenced=True, remove_tags=True))


@query(_CLOSED_ID_SQL + " SELECT type, id FROM every ANTI JOIN (SELECT * FROM objs WHERE NOT (type = 'n' AND id % 10 = 3)) USING (type, id)")
def getid_missing_referenced(spark, sf_dir):
    holed = t.stored(spark, sf_dir).where("not (type = 'n' and id % 10 = 3)")
    return rf.missing_ids(holed, _ids(spark, sf_dir), add_referenced=True)


@query(_CHANGESETS.replace("n::INTEGER AS num_changes", "CASE WHEN (u * 100000 + d) % 5 = 0 THEN 0 ELSE n END::INTEGER AS num_changes") + "num_changes = 0 AND num_comments = 0", "")
def changeset_filter_without_changes(spark, sf_dir):
    found = t.changesets(spark, sf_dir).withColumn("num_changes", F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("num_changes")))
    out = fl.changeset_filter(found, with_changes=False, with_discussion=False)
    return out.select("id", F.unix_micros("created_at").alias("created"), F.unix_micros("closed_at").alias("closed"), "num_changes", "num_comments", "uid", "user", "min_lon_e7", "min_lat_e7")


@query(" SELECT * FROM objs WHERE (type = 'n' AND id IN (SELECT p_partkey + 1 FROM part WHERE p_partkey % 9 = 0)) OR (type = 'w' AND id IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderkey % 8 = 0))")
def getid_of_file(spark, sf_dir):
    """Ids from a text file with remarks and blank lines."""
    path = scratch_path(spark, "ids")
    lines = t.table(spark, sf_dir, "part").where("p_partkey % 9 = 0").select(F.concat((F.col("p_partkey") + 1).cast("string"), F.lit(" # a remark")).alias("value"))
    lines = lines.union(t.table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0").select(F.concat(F.lit("w"), (F.col("o_orderkey") + 1).cast("string"))))
    lines.union(spark.createDataFrame([("",), ("# none",)], "value string")).write.text(path)
    return flat(rf.get_ids(t.objects(spark, sf_dir), ids.read_ids(spark, path, "n")))


@query(" SELECT * FROM objs WHERE (type = 'w' AND tags LIKE 'status=P;%') OR (type = 'r' AND tags LIKE 'type=site;%')")
def tags_filter_of_file(spark, sf_dir):
    """Expressions from a file."""
    path = scratch_path(spark, "expressions")
    spark.createDataFrame([("w/status=P # open orders\n\n# nothing\nr/type=site\n",)], "value string").coalesce(1).write.text(path)
    lines = boundaries.read_text(spark, path).split("\n")
    return flat(fl.tags_filter(t.objects(spark, sf_dir), read_expressions(lines), add_referenced=False))


@query(""", kept AS (SELECT c_custkey + 1 AS id FROM customer)
  SELECT o.type, o.id FROM objs o WHERE o.type <> 'n' OR o.id % 3 = 0 OR o.id IN (SELECT id FROM kept)""")
def add_locations_member_nodes(spark, sf_dir):
    """Two nodes of three have no tags, and each customer's relation has a node as a member."""
    objects = t.objects(spark, sf_dir).withColumn("tags", F.when((F.col("type") == "n") & (F.col("id") % 3 != 0), F.slice("tags", 1, 0)).otherwise(F.col("tags")))
    node = F.array(F.struct(F.lit("n").alias("type"), F.col("id").alias("ref"), F.lit("").alias("role")))
    objects = objects.withColumn("members", F.when((F.col("type") == "r") & (F.col("id") < 1_000_000), node).otherwise(F.col("members")))
    return lo.add_locations(materialise(objects, "objects"), keep_member_nodes=True).select("type", "id")


# --- changes, new ids -----------------------------------------------------------------------------


@query(_WITH_CHANGES + "SELECT 'w' AS type, id, version, uid::INTEGER AS uid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, src DESC) AS n FROM every) WHERE n = 1 AND visible")
def replication_stream(spark, sf_dir):
    """The change file as a stream of two batches, each of all files that have come since the one before."""
    folder, root = scratch_path(spark, "stream"), scratch_path(spark, "followed")
    changes = t.changes(spark, sf_dir)
    for part in (0, 1):
        changes.where(F.pmod("id", F.lit(2)) == part).write.mode("append").parquet(folder)
        stream = replication.change_stream(spark, folder, 1_000_000)
        start = None if part else t.ways(spark, sf_dir)
        replication.follow(stream, root, start, available_now=True, compact_every=2 if sf_dir.endswith("1") else 3).awaitTermination()
    return replication.state(spark, root, 2).select("type", "id", "version", "uid")


_PLACED = "string_agg(r.ref || ':' || n.lon || ':' || n.lat, ',' ORDER BY r.pos)"


@query(f""", n AS (SELECT id, CASE WHEN id % 5 = 0 THEN lon + 17 ELSE lon END AS lon, lat FROM nodes)
  SELECT w.id, coalesce((SELECT {_PLACED} FROM refs r JOIN n ON n.id = r.ref WHERE r.way = w.id), '') AS refs FROM ways w""")
def apply_changes_old_nodes(spark, sf_dir):
    """Nodes of a change file give their place even if the data has a later version."""
    nodes = t.nodes(spark, sf_dir).where("id % 5 = 0").withColumns({"version": F.when(F.col("id") % 10 == 0, 0).otherwise(2), "lon_e7": (F.col("lon_e7") + 17).cast("int")})
    out = ch.apply_changes_locations(lo.refreshed_locations(t.stored(spark, sf_dir)), [nodes])
    place = F.transform("refs", lambda r: F.concat_ws(":", r["ref"].cast("string"), r["lon_e7"].cast("string"), r["lat_e7"].cast("string")))
    return out.where("type = 'w'").select("id", F.array_join(place, ",").alias("refs"))


@query(""", first_refs AS (SELECT ref, min(way * 10000000 + pos) AS place FROM refs WHERE (way - 1) % 2 = 0 GROUP BY ref),
  old_nodes AS (SELECT ref, row_number() OVER (ORDER BY place) AS new_id FROM first_refs),
  new_refs AS (SELECT ref, min(way * 10000000 + pos) AS place FROM refs WHERE ref NOT IN (SELECT ref FROM old_nodes) GROUP BY ref),
  old_ways AS (SELECT id, row_number() OVER (ORDER BY id) AS new_id FROM ways WHERE (id - 1) % 2 = 0)
  SELECT 'n' AS type, ref AS old_id, new_id FROM old_nodes UNION ALL SELECT 'n', ref, (SELECT count(*) FROM old_nodes) + row_number() OVER (ORDER BY place) FROM new_refs
  UNION ALL SELECT 'w', id, new_id FROM old_ways UNION ALL SELECT 'w', id, (SELECT count(*) FROM old_ways) + row_number() OVER (ORDER BY id) FROM ways WHERE (id - 1) % 2 = 1""")
def renumber_index(spark, sf_dir):
    """The map of half the ways, written and read, then gone on with for all."""
    ways, path = t.ways(spark, sf_dir), scratch_path(spark, "renumber-index")
    rn.renumber_map(ways.where("(id - 1) % 2 = 0"), types="nw").write.parquet(path)
    return rn.renumber_map(ways, types="nw", before=spark.read.parquet(path))


@query(_LATER + """, compared AS (SELECT coalesce(o.id, l.id) AS id, coalesce(o.version, l.version) AS version, CASE WHEN l.id IS NULL THEN 'left' WHEN o.id IS NULL THEN 'right' WHEN o.uid = l.uid THEN 'same' ELSE 'different' END AS what
  FROM (SELECT *, 1 AS version FROM ways) o FULL JOIN later l ON o.id = l.id AND o.version = l.version)
  SELECT id, version, what, CASE WHEN what = 'right' THEN NULL ELSE (SELECT uid FROM ways w WHERE w.id = c.id) END::INTEGER AS old_uid, CASE WHEN what = 'left' THEN NULL ELSE (SELECT uid FROM later l WHERE l.id = c.id AND l.version = c.version) END::INTEGER AS new_uid FROM compared c""")
def diff_rows(spark, sf_dir):
    """Both rows of each version, as the long outputs show them."""
    found = ch.diff(t.ways(spark, sf_dir), t.later_ways(spark, sf_dir), keep_rows=True)
    what = F.element_at(F.create_map(*[F.lit(x) for x in ("-", "left", "+", "right", " ", "same", "*", "different")]), F.col("status"))
    return found.select("id", "version", what.alias("what"), F.col("old.uid").alias("old_uid"), F.col("new.uid").alias("new_uid"))


# --- extracts -------------------------------------------------------------------------------------


def _smart(name: str, where: str, **options) -> None:
    def run(spark, sf_dir):
        return xt.extract_ids(t.stored(spark, sf_dir), {"a": _BOX}, "smart", **options)

    run.__name__ = f"extract_smart_{name}"
    query(_sets(_IN_BOX) + f""", sizes AS (SELECT rel, count(*) AS n FROM members GROUP BY rel),
  have AS (SELECT m.rel, count(*) AS wanted FROM members m JOIN W ON m.type = 'w' AND W.id = m.ref GROUP BY m.rel),
  complete AS (SELECT 'a' AS extract, r.id FROM relations r JOIN sizes s ON s.rel = r.id JOIN have h ON h.rel = r.id WHERE {where}),
  AW AS (SELECT extract, id FROM W UNION SELECT c.extract, m.ref FROM complete c JOIN members m ON m.rel = c.id AND m.type = 'w'),
  AN AS (SELECT * FROM N UNION SELECT extract, ref FROM refs JOIN AW ON AW.id = way)
  SELECT extract, 'n' AS type, id FROM AN UNION ALL SELECT extract, 'w', id FROM AW UNION ALL SELECT extract, 'r', id FROM Up""")(run)


_smart("percent", "kind = 'site' OR wanted * 100 >= n * 40", types=["site"], complete_percent=40)
_smart("tags", "(kind = 'route' OR wanted >= n) AND name IN ('BUILDING', 'MACHINERY')", types=["route"], complete_tags=["name=BUILDING,MACHINERY"])
_smart("any", "true", types=["any"])


_VERSIONS = """, node_versions AS (SELECT id, 1 AS version, lon, lat FROM nodes UNION ALL SELECT id, 2, -lon, -lat FROM nodes WHERE id % 4 = 0),
  way_refs AS (SELECT way, ref, pos, 1 AS version FROM refs UNION ALL SELECT way, ref, pos, 2 FROM refs WHERE way % 5 = 0 AND pos > 1
    UNION ALL SELECT way, (SELECT min(id) FROM nodes), 1, 2 FROM refs WHERE way % 5 = 0 AND pos = 1) """


@query(_VERSIONS + """, N AS (SELECT DISTINCT id FROM node_versions WHERE lon BETWEEN -500000000 AND 300000000 AND lat BETWEEN -350000000 AND 200000000),
  W AS (SELECT DISTINCT way AS id FROM way_refs WHERE ref IN (SELECT id FROM N)),
  R AS (SELECT DISTINCT rel AS id FROM members m WHERE m.type = 'w' AND m.ref IN (SELECT id FROM W)),
  Up AS (SELECT id FROM R UNION SELECT m.rel FROM Up u JOIN members m ON m.type = 'r' AND m.ref = u.id),
  AN AS (SELECT id FROM N UNION SELECT ref FROM way_refs WHERE way IN (SELECT id FROM W))
  SELECT 'n' AS type, id, version FROM node_versions WHERE id IN (SELECT id FROM AN) UNION ALL SELECT 'w', id, 1 FROM W UNION ALL SELECT 'w', id, 2 FROM W WHERE id % 5 = 0 UNION ALL SELECT 'r', id, 1 FROM Up""")
def extract_history(spark, sf_dir):
    """Nodes that moved and ways whose first node changed: what any version has to do with the box comes with all versions."""
    objects = t.stored(spark, sf_dir)
    nodes, ways = objects.where("type = 'n'"), objects.where("type = 'w'")
    least = nodes.agg(F.min("id")).first()[0]
    moved = nodes.where("id % 4 = 0").withColumns({"version": F.lit(2), "lon_e7": -F.col("lon_e7"), "lat_e7": -F.col("lat_e7")})
    other = F.transform("refs", lambda r, i: F.struct(F.when(i == 0, F.lit(least)).otherwise(r["ref"]).alias("ref"), r["lon_e7"].alias("lon_e7"), r["lat_e7"].alias("lat_e7")))
    later = ways.where("id % 5 = 0").withColumns({"version": F.lit(2), "refs": other})
    every = materialise(objects.unionByName(moved).unionByName(later), "versions")
    return xt.extract(every, {"a": _BOX}, history=True).select("type", "id", "version")


def _star(points: int, wide: float, high: float, x: float, y: float) -> list[list[float]]:
    """A closed ring of degrees with points turned in and out."""
    ring = []
    for i in range(points):
        far = 1.0 if i % 2 else 0.55
        a = 2 * math.pi * i / points
        ring.append([round(x + wide * far * math.cos(a), 5), round(y + high * far * math.sin(a), 5)])
    return [*ring, ring[0]]


_STARS = {
    "a": boundaries.of_geojson(json.dumps({"type": "Polygon", "coordinates": [_star(160, 150.00003, 75.00007, 3.3, 4.7), _star(40, 40.00001, 20.00003, 3.3, 4.7)[::-1]]})),
    "b": boundaries.of_poly("stars\n1\n" + "\n".join(f" {x} {y}" for x, y in _star(80, 50.00009, 30.00005, -80.1, 20.2)) + "\nEND\n2\n" + "\n".join(f" {x} {y}" for x, y in _star(6, 20.00007, 30.00003, 100.5, -40.5)) + "\nEND\nEND\n"),
}


def _crossings(region: Region, name: str) -> str:
    edges = ", ".join(f"({x1}, {y1}, {x2}, {y2})" for x1, y1, x2, y2 in region.edges())
    return f"""SELECT '{name}' AS extract, n.id FROM nodes n CROSS JOIN (VALUES {edges}) e(x1, y1, x2, y2) WHERE n.lon BETWEEN {region.box[0]} AND {region.box[2]} AND n.lat BETWEEN {region.box[1]} AND {region.box[3]}
  GROUP BY n.id HAVING bool_or(n.lon = x1 AND n.lat = y1) OR count(*) FILTER ((n.lat < y2) <> (n.lat < y1) AND (y1 > y2) = ((n.lon - x2)::HUGEINT * (y1 - y2) < (x1 - x2)::HUGEINT * (n.lat - y2))) % 2 = 1"""


@query(f", N AS ({_crossings(_STARS['a'], 'a')} UNION ALL {_crossings(_STARS['b'], 'b')}) SELECT extract, 'n' AS type, id FROM N UNION ALL SELECT DISTINCT extract, 'w', way FROM refs JOIN N ON N.id = ref")
def extract_many_edges(spark, sf_dir):
    """Polygons of many edges, with a hole and of two parts, one from GeoJSON and one from a polygon file."""
    found = xt.extract_ids(t.stored(spark, sf_dir), _STARS, "simple")
    return found.where("type <> 'r'")


def _boxes(n: int) -> dict[str, Region]:
    out = {}
    for i in range(n):
        x, y = (i * 97) % 300 - 150, (i * 61) % 140 - 70
        out[f"r{i}"] = Region.of_box((x * 10_000_000, y * 10_000_000), ((x + 5 + i % 20) * 10_000_000, (y + 3 + i % 11) * 10_000_000))
    return out


_MANY = _boxes(400)
_MANY_SQL = ", ".join(f"('{k}', {a}, {b}, {c}, {d})" for k, (a, b, c, d) in ((k, r.box) for k, r in _MANY.items()))


@query(f" SELECT b.name AS extract, n.id FROM nodes n JOIN (VALUES {_MANY_SQL}) b(name, x1, y1, x2, y2) ON n.lon BETWEEN x1 AND x2 AND n.lat BETWEEN y1 AND y2")
def extract_many_regions(spark, sf_dir):
    """Four hundred boxes in one pass."""
    return xt.extract_ids(t.nodes(spark, sf_dir), _MANY, "simple").where("type = 'n'").select("extract", "id")


# --- export ---------------------------------------------------------------------------------------

#: Relations whose rings close: segments that ways have in common cancel out, and what is left meets in pairs.
_BUILT = """, chosen AS (SELECT *, WANTED AS wanted FROM members), steps AS (SELECT way, ref AS a, lead(ref) OVER (PARTITION BY way ORDER BY pos) AS b FROM closed_refs),
  segments AS (SELECT m.rel, least(s.a, s.b) AS a, greatest(s.a, s.b) AS b FROM steps s JOIN chosen m ON m.type = 'w' AND m.ref = s.way JOIN relations r ON r.id = m.rel AND r.kind IN ('multipolygon', 'boundary')
    WHERE m.wanted AND s.b IS NOT NULL AND s.a <> s.b GROUP BY m.rel, 2, 3 HAVING count(*) % 2 = 1),
  corners AS (SELECT rel, node, count(*) AS n FROM (SELECT rel, a AS node FROM segments UNION ALL SELECT rel, b FROM segments) GROUP BY rel, node),
  built AS (SELECT rel FROM corners GROUP BY rel HAVING bool_and(n % 2 = 0)) """
_CLOSED = """, ends AS (SELECT way, count(*) AS n, arg_min(ref, pos) AS a, arg_max(ref, pos) AS b FROM closed_refs GROUP BY way),
  sited AS (SELECT e.way, e.n, (x.lon = y.lon AND x.lat = y.lat) AS closed FROM ends e JOIN nodes x ON x.id = e.a JOIN nodes y ON y.id = e.b) """


@query(_BUILT.replace("WANTED", "(ref - 1) % 3 = 0") + """, drawn AS (SELECT s.rel, x.lon || ' ' || x.lat AS p, y.lon || ' ' || y.lat AS q FROM segments s JOIN built USING (rel) JOIN nodes x ON x.id = s.a JOIN nodes y ON y.id = s.b)
  SELECT 'a' || (2 * rel + 1) AS feature_id, count(*) AS segments, md5(string_agg(least(p, q) || '-' || greatest(p, q), ',' ORDER BY least(p, q) || '-' || greatest(p, q))) AS outline FROM drawn GROUP BY rel""")
def export_relation_areas(spark, sf_dir):
    """The segments of all rings of relations' areas; members are closed ways only."""
    whole = F.filter("members", lambda m: (m["type"] != "w") | ((m["ref"] - 1) % 3 == 0))
    objects = materialise(t.objects(spark, sf_dir, closed=True).withColumn("members", whole), "objects")
    made = ex.features(objects, ex.ExportConfig(geometry_types=("polygon",), object_types=("r",)))[0]
    point = lambda p: F.concat(p["lon_e7"].cast("string"), F.lit(" "), p["lat_e7"].cast("string"))
    sides = lambda ring: F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(point(F.get(ring, i - 1)).alias("p"), point(F.get(ring, i)).alias("q")))
    every = F.flatten(F.transform(F.flatten("area"), sides))
    text = F.transform(every, lambda s: F.concat(F.least(s["p"], s["q"]), F.lit("-"), F.greatest(s["p"], s["q"])))
    return made.select("feature_id", F.size(text).cast("long").alias("segments"), F.md5(F.array_join(F.sort_array(text), ",")).alias("outline"))


@query(_BUILT.replace("WANTED", "true") + _CLOSED + """ SELECT 'w' AS type, id, 'way without two located nodes' AS reason FROM ways LEFT JOIN ends ON way = id WHERE coalesce(n, 0) < 2
  UNION ALL SELECT 'w', way, 'area of fewer than four nodes' FROM sited WHERE closed AND n BETWEEN 2 AND 3
  UNION ALL SELECT 'r', id, 'relation without closed rings' FROM relations WHERE kind IN ('multipolygon', 'boundary') AND id NOT IN (SELECT rel FROM built)""")
def export_all_errors(spark, sf_dir):
    return ex.features(t.stored(spark, sf_dir, closed=True))[1]


def _le(x: str) -> str:
    """A double as 16 hexadecimal digits, last byte first."""
    return " || ".join(f"substr(hex(({x})::DOUBLE::BIT::BLOB), {i}, 2)" for i in range(15, 0, -2))


_PAIR = f"{_le('n.lon::DOUBLE / 1e7')} || {_le('n.lat::DOUBLE / 1e7')}"


@query(f""", shapes AS (SELECT way, string_agg({_PAIR}, '' ORDER BY r.pos) AS pairs, count(*) AS size FROM refs r JOIN nodes n ON n.id = r.ref GROUP BY way)
  SELECT '0101000020E6100000' || {_PAIR} || chr(9) || id || chr(9) || '\\N' || chr(9) || '{{"brand":"' || brand || '","type":"' || kind || '","name":"' || name || '"}}' AS line FROM nodes n
  UNION ALL SELECT '0102000020E6100000' || printf('%02X', size) || '000000' || pairs || chr(9) || id || chr(9) || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || chr(9) || '{{"status":"' || status || '","priority":"' || priority || '"}}' FROM shapes JOIN ways ON way = id WHERE size >= 2""")
def export_copy_lines(spark, sf_dir):
    """Lines for COPY, geometry as EWKB."""
    config = ex.ExportConfig({"id": "id", "timestamp": "at"}, geometry_types=("point", "linestring"))
    return ex.pg_features(ex.features(t.stored(spark, sf_dir), config)[0], config)


@query(f""" SELECT 'POINT(' || {_LON} || ' ' || {_LAT} || ') brand=' || brand AS line FROM nodes n""")
def export_include_tags(spark, sf_dir):
    config = ex.read_config('{"include_tags": ["brand", "type=none"]}', geometry_types=("point",))
    return ex.text_features(ex.features(t.nodes(spark, sf_dir), config)[0], config)


@query(f""" SELECT row_number() OVER (ORDER BY id) || ' POINT(' || {_LON} || ' ' || {_LAT} || ') name=' || name AS line FROM nodes n""")
def export_counter_ids(spark, sf_dir):
    config = ex.read_config('{"exclude_tags": ["brand", "type"]}', geometry_types=("point",), unique_id="counter")
    return ex.text_features(ex.features(t.nodes(spark, sf_dir), config)[0], config)


@query(f""", shapes AS (SELECT way, string_agg({_LON} || ' ' || {_LAT}, ',' ORDER BY r.pos) AS path, count(*) AS size FROM refs r JOIN nodes n ON n.id = r.ref GROUP BY way)
  SELECT 'LINESTRING(' || path || ') @t=way,@at=' || epoch(ts)::BIGINT || ',@of=' || replace(refs, ',', '/') || ',status=' || status || ',priority=' || priority AS line FROM shapes JOIN ways ON way = id WHERE size >= 2""")
def export_attributes(spark, sf_dir):
    config = ex.read_config('{"attributes": {"type": "@t", "timestamp": "@at", "way_nodes": "@of", "uid": false}}', geometry_types=("linestring",))
    return ex.text_features(ex.features(t.stored(spark, sf_dir), config)[0], config)


def _rules(name: str, config: str, line: str, area: str) -> None:
    """line, area: what the rules say of a closed way without an area tag."""

    def run(spark, sf_dir):
        said = F.when(F.col("priority") == "1-URGENT", "yes").when(F.col("priority") == "2-HIGH", "no")
        objects = t.stored(spark, sf_dir, closed=True).withColumn("priority", F.get(F.filter("tags", lambda x: x["k"] == "priority"), F.lit(0))["v"])
        tag = F.when((F.col("type") == "w") & said.isNotNull(), F.array(F.struct(F.lit("area").alias("k"), said.alias("v")))).otherwise(F.slice("tags", 1, 0))
        objects = objects.withColumn("tags", F.concat("tags", tag)).drop("priority")
        made = ex.features(objects, ex.read_config(config, geometry_types=("linestring", "polygon"), object_types=("w",)))[0]
        return made.select("feature_id", "geometry_type")

    run.__name__ = f"export_rules_{name}"
    query(_CLOSED + f""", said AS (SELECT s.*, w.status, CASE priority WHEN '1-URGENT' THEN 'yes' WHEN '2-HIGH' THEN 'no' END AS area_tag FROM sited s JOIN ways w ON w.id = s.way WHERE n >= 2)
  SELECT 'w' || way AS feature_id, 'LineString' AS geometry_type FROM said WHERE NOT closed OR CASE area_tag WHEN 'no' THEN true WHEN 'yes' THEN false ELSE {line} END
  UNION ALL SELECT 'a' || (2 * way), 'MultiPolygon' FROM said WHERE closed AND n >= 4 AND CASE area_tag WHEN 'no' THEN false WHEN 'yes' THEN true ELSE {area} END""")(run)


_rules("list_and_other", '{"linear_tags": ["status=P"], "area_tags": null}', "status = 'P'", "status <> 'P'")
_rules("other_and_list", '{"linear_tags": null, "area_tags": ["status=O,F"]}', "status NOT IN ('O', 'F')", "status IN ('O', 'F')")
_rules("any_and_none", '{"linear_tags": true, "area_tags": false}', "true", "false")
_rules("none_and_any", '{"linear_tags": false, "area_tags": true}', "false", "true")


# --- files ----------------------------------------------------------------------------------------

_EVERYTHING = """ SELECT o.type, o.id, o.version, o.tags, o.refs, CASE WHEN o.type = 'w' THEN (SELECT epoch(ts)::BIGINT FROM ways w WHERE w.id = o.id) END AS seconds,
  CASE WHEN o.type = 'w' THEN (SELECT uid FROM ways w WHERE w.id = o.id) ELSE 0 END::INTEGER AS uid, n.lon::INTEGER AS lon_e7, n.lat::INTEGER AS lat_e7 FROM objs o LEFT JOIN nodes n ON o.type = 'n' AND o.id = n.id"""


def _round_trip(suffix: str) -> None:
    """Objects written as files of a format and read again; the parts of XML are one document."""

    def run(spark, sf_dir):
        path = f"{scratch_path(spark, 'objects')}.{suffix}"
        ordered = t.objects(spark, sf_dir).orderBy("_seq")
        files.write(Dataset(ordered), path, suffix)
        found = files.read(spark, [path], suffix).df
        return flat(found.withColumn("seconds", F.unix_timestamp("timestamp")), "seconds", "uid", "lon_e7", "lat_e7")

    run.__name__ = f"files_{suffix.replace('.', '_')}"
    query(_EVERYTHING)(run)


_round_trip("opl")
_round_trip("opl.gz")
_round_trip("osm.bz2")
_round_trip("osm.pbf")
_round_trip("parquet")


@query(_LATER + "SELECT 'w' AS type, id, version, visible, uid::INTEGER AS uid, CASE WHEN visible THEN refs ELSE refs END AS refs FROM change")
def files_osc(spark, sf_dir):
    """A change file written and read again: versions, deletions and their order."""
    path = f"{scratch_path(spark, 'changes')}.osc"
    changes = t.changes(spark, sf_dir).orderBy("_seq")
    files.write(Dataset(changes, kind="change"), path, "osc")
    found = xmlfile.read_changes(spark, path)
    refs = F.array_join(F.transform("refs", lambda r: r["ref"].cast("string")), ",")
    return found.select("type", "id", "version", "visible", "uid", F.coalesce(refs, F.lit("")).alias("refs"))


@query(" SELECT min(lon)::INTEGER AS a, min(lat)::INTEGER AS b, max(lon)::INTEGER AS c, max(lat)::INTEGER AS d FROM nodes")
def header_box(spark, sf_dir):
    """The box of a merged header: two files, each with the box of half the nodes, sorted into one, written and read."""
    nodes = t.nodes(spark, sf_dir)
    inputs = []
    for part in (0, 1):
        half = nodes.where(F.col("id") % 2 == part)
        box = half.agg(F.min("lon_e7"), F.min("lat_e7"), F.max("lon_e7"), F.max("lat_e7")).first()
        path = f"{scratch_path(spark, 'half')}.osm.pbf"
        files.write(Dataset(half.orderBy("_seq"), files.Header(boxes=(tuple(box),))), path, "osm.pbf")
        inputs.append(files.read(spark, [path], "osm.pbf"))
    merged = mg.sort_datasets(inputs)
    return spark.createDataFrame([merged.header.joined_box()], "a int, b int, c int, d int")

"""Queries over map data, one for each operator, and what they say in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.functions.geometry import Region
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
from waymill.plans.tables import PRELUDE, flat
from waymill.scratch import materialise, numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prelude: str = PRELUDE):
    """Register a query under its function's name; sql follows the prelude."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = prelude + sql
        return f

    return add


def _filtered(name: str, sql: str, *expressions: str, closed: bool = False, **options) -> None:
    def run(spark, sf_dir):
        return flat(fl.tags_filter(t.objects(spark, sf_dir, closed), list(expressions), add_referenced=False, **options))

    run.__name__ = name
    query(sql)(run)


# --- scans, unions, projections -------------------------------------------------------------------


@query("SELECT type, id, version, tags, refs, 0 AS _src FROM objs WHERE type <> 'n' UNION ALL SELECT type, id, 0, tags, refs, 1 FROM objs WHERE type = 'w'")
def cat_union(spark, sf_dir):
    first = fl.of_types(t.objects(spark, sf_dir), "wr")
    return flat(mg.concatenate([first, mg.clean(t.ways(spark, sf_dir), ["version"])]), "_src")


@query("SELECT type, id, 0 AS version, tags, refs, NULL::BIGINT AS seconds, 0 AS uid, '' AS \"user\" FROM objs WHERE type = 'w'")
def clean_attrs(spark, sf_dir):
    out = mg.clean(t.ways(spark, sf_dir), ["version", "timestamp", "uid", "user", "changeset"])
    return flat(out.withColumn("seconds", F.unix_timestamp("timestamp")), "seconds", "uid", "user")


@query("SELECT * FROM objs WHERE type IN ('n', 'r')")
def type_filter(spark, sf_dir):
    return flat(fl.of_types(t.objects(spark, sf_dir), "nr"))


# --- tag filters ----------------------------------------------------------------------------------

_filtered("tags_filter_key", "SELECT * FROM objs WHERE type = 'w'", "w/priority")
_filtered("tags_filter_value", "SELECT * FROM objs WHERE type = 'w' AND tags LIKE 'status=F;%'", "nw/status=F")
_filtered("tags_filter_negated", "SELECT * FROM objs WHERE (type = 'w' AND tags NOT LIKE 'status=F;%')", "status!=F")
_filtered("tags_filter_prefix", "SELECT o.* FROM objs o JOIN nodes n ON o.type = 'n' AND o.id = n.id WHERE starts_with(n.brand, 'Brand#1')", "brand=Brand#1*")
_filtered("tags_filter_substring", "SELECT o.* FROM objs o JOIN nodes n ON o.type = 'n' AND o.id = n.id WHERE contains(n.name, 'red')", "n/name=*red*")
_filtered("tags_filter_list", "SELECT * FROM objs WHERE tags LIKE '%priority=1-URGENT' OR tags LIKE '%priority=2-HIGH'", "priority=1-URGENT, 2-HIGH")
_filtered("tags_filter_invert", "SELECT * FROM objs WHERE type <> 'w' OR tags NOT LIKE 'status=F;%'", "w/status=F", invert=True)
_filtered(
    "tags_filter_area",
    """, closed AS (SELECT way, string_agg(ref::VARCHAR, ',' ORDER BY pos) AS refs, count(*) AS n, arg_min(ref, pos) AS a, arg_max(ref, pos) AS b FROM closed_refs GROUP BY way)
    SELECT o.type, o.id, o.version, o.tags, c.refs FROM objs o JOIN closed c ON o.type = 'w' AND o.id = c.way WHERE c.n >= 4 AND c.a = c.b
    UNION ALL SELECT * FROM objs WHERE type = 'r' AND (tags LIKE 'type=multipolygon;%' OR tags LIKE 'type=boundary;%')""",
    "a/status,type",
    closed=True,
)


@query("""
, seeds AS (SELECT id FROM objs WHERE type = 'r' AND tags LIKE '%;name=NATION_3'),
deep AS (SELECT id FROM seeds UNION SELECT m.ref FROM deep d JOIN members m ON m.rel = d.id AND m.type = 'r'),
rel AS (SELECT ref AS id FROM members WHERE type = 'r' AND rel IN (SELECT id FROM deep) UNION SELECT id FROM seeds),
way AS (SELECT ref AS id FROM members WHERE type = 'w' AND rel IN (SELECT id FROM deep)),
node AS (SELECT DISTINCT ref AS id FROM refs WHERE way IN (SELECT id FROM way))
SELECT * FROM objs WHERE (type = 'r' AND id IN (SELECT id FROM rel)) OR (type = 'w' AND id IN (SELECT id FROM way)) OR (type = 'n' AND id IN (SELECT id FROM node))""")
def tags_filter_complete(spark, sf_dir):
    return flat(fl.tags_filter(t.stored(spark, sf_dir), ["r/name=NATION_3"]))


# --- ids ------------------------------------------------------------------------------------------


def _ids(spark, sf_dir):
    part, orders = t.table(spark, sf_dir, "part"), t.table(spark, sf_dir, "orders")
    ids = part.where("p_partkey % 7 = 0").select(F.lit("n").alias("type"), (F.col("p_partkey") + 1).alias("id"))
    ids = ids.union(orders.where("o_orderkey % 11 = 0").select(F.lit("w"), F.col("o_orderkey") + 1))
    return ids.union(spark.range(2_000_001, 2_000_003).select(F.lit("r"), "id")).union(spark.range(900_000_000, 900_000_005).select(F.lit("w"), "id"))


_ID_SQL = """
, ids AS (SELECT 'n' AS type, p_partkey + 1 AS id FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT 'w', o_orderkey + 1 FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL SELECT 'r', unnest([2000001, 2000002]) UNION ALL SELECT 'w', unnest([900000000, 900000001, 900000002, 900000003, 900000004]))"""
_CLOSED_ID_SQL = (
    _ID_SQL
    + """
, deep AS (SELECT id FROM ids WHERE type = 'r' UNION SELECT m.ref FROM deep d JOIN members m ON m.rel = d.id AND m.type = 'r'),
pulled AS (SELECT m.type, m.ref AS id FROM members m WHERE m.rel IN (SELECT id FROM deep)),
every AS (SELECT type, id FROM ids UNION SELECT type, id FROM pulled
  UNION SELECT 'n', ref FROM refs WHERE way IN (SELECT id FROM ids WHERE type = 'w' UNION SELECT id FROM pulled WHERE type = 'w'))"""
)


@query(_ID_SQL + " SELECT o.* FROM objs o SEMI JOIN ids USING (type, id)")
def getid(spark, sf_dir):
    return flat(rf.get_ids(t.objects(spark, sf_dir), _ids(spark, sf_dir)))


@query(_CLOSED_ID_SQL + " SELECT o.* FROM objs o SEMI JOIN every USING (type, id)")
def getid_referenced(spark, sf_dir):
    return flat(rf.get_ids(t.stored(spark, sf_dir), _ids(spark, sf_dir), add_referenced=True))


@query(_ID_SQL + " SELECT type, id FROM ids ANTI JOIN objs USING (type, id)")
def getid_missing(spark, sf_dir):
    return rf.missing_ids(t.objects(spark, sf_dir), _ids(spark, sf_dir))


@query(_ID_SQL + " SELECT o.* FROM objs o ANTI JOIN ids USING (type, id)")
def removeid(spark, sf_dir):
    return flat(rf.remove_ids(t.objects(spark, sf_dir), _ids(spark, sf_dir)))


_PARENT_SQL = _ID_SQL + ", up AS (SELECT 'w' AS type, way AS id FROM refs JOIN ids ON ids.type = 'n' AND ids.id = ref UNION SELECT 'r', rel FROM members m JOIN ids ON ids.type = m.type AND ids.id = m.ref)"


@query(_PARENT_SQL + " SELECT o.* FROM objs o SEMI JOIN up USING (type, id)")
def getparents(spark, sf_dir):
    return flat(rf.get_parents(t.stored(spark, sf_dir), _ids(spark, sf_dir)))


@query(_PARENT_SQL + " SELECT o.* FROM objs o SEMI JOIN (SELECT * FROM up UNION SELECT type, id FROM ids) USING (type, id)")
def getparents_self(spark, sf_dir):
    return flat(rf.get_parents(t.stored(spark, sf_dir), _ids(spark, sf_dir), add_self=True))


# --- changesets and time --------------------------------------------------------------------------

_CHANGESETS = """
WITH days AS (SELECT user_id AS u, date_diff('day', DATE '1970-01-01', ts::DATE) AS d, min(ts) AS a, max(ts) AS z, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1, 2),
cs AS (SELECT u * 100000 + d AS id, epoch_us(a) AS created, CASE WHEN u % 10 <> 0 THEN epoch_us(z) END AS closed, n::INTEGER AS num_changes, c::INTEGER AS num_comments, (u + 1)::INTEGER AS uid, 'user' || u AS "user",
  CASE WHEN u % 7 <> 0 THEN (((u * 7919) % 3500 - 1800) * 1000000)::INTEGER END AS lon, CASE WHEN u % 7 <> 0 THEN (((u * 104729) % 1700 - 900) * 1000000)::INTEGER END AS lat FROM days)
SELECT id, created, closed, num_changes, num_comments, uid, "user", lon AS min_lon_e7, lat AS min_lat_e7 FROM cs WHERE """
_NOON = datetime(2024, 1, 15, 12)


def _changesets(name: str, where: str, **conditions) -> None:
    def run(spark, sf_dir):
        out = fl.changeset_filter(t.changesets(spark, sf_dir), **conditions)
        return out.select("id", F.unix_micros("created_at").alias("created"), F.unix_micros("closed_at").alias("closed"), "num_changes", "num_comments", "uid", "user", "min_lon_e7", "min_lat_e7")

    run.__name__ = f"changeset_filter_{name}"
    query(where, _CHANGESETS)(run)


_changesets("open", "closed IS NULL", open_=True)
_changesets("closed", "closed IS NOT NULL", open_=False)
_changesets("discussion", "num_comments > 0 AND num_changes > 0", with_discussion=True, with_changes=True)
_changesets("no_discussion", "num_comments = 0", with_discussion=False)
_changesets("user", "\"user\" = 'user8' AND uid = 9", user="user8", uid=9)
_changesets("time", "(closed IS NULL OR closed >= epoch_us(TIMESTAMP '2024-01-15 12:00:00')) AND created <= epoch_us(TIMESTAMP '2024-01-20')", after=_NOON, before=datetime(2024, 1, 20))
_changesets("bbox", "lon <= 500000000 AND lon + 100000000 >= -300000000 AND lat <= 400000000 AND lat + 100000000 >= -200000000", bbox=(-300_000_000, -200_000_000, 500_000_000, 400_000_000))

_HISTORY = """
WITH v AS (SELECT user_id + 1 AS id, row_number() OVER w AS version, ts, lead(ts) OVER w AS until, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'n' AS type, id, version::INTEGER AS version, 'event=' || event_type AS tags, '' AS refs, epoch_us(ts) AS at FROM v WHERE """


@query("ts <= TIMESTAMP '2024-01-15 12:00:00' AND (until IS NULL OR until > TIMESTAMP '2024-01-15 12:00:00') AND event_type <> 'error'", _HISTORY)
def time_filter_point(spark, sf_dir):
    out = fl.time_filter(t.history(spark, sf_dir), _NOON)
    return flat(out.withColumn("at", F.unix_micros("timestamp")), "at")


@query("ts < TIMESTAMP '2024-01-17' AND CASE WHEN ts = until THEN until >= TIMESTAMP '2024-01-15 12:00:00' ELSE until IS NULL OR until > TIMESTAMP '2024-01-15 12:00:00' END", _HISTORY)
def time_filter_range(spark, sf_dir):
    out = fl.time_filter(t.history(spark, sf_dir), _NOON, datetime(2024, 1, 17))
    return flat(out.withColumn("at", F.unix_micros("timestamp")), "at")


# --- summaries ------------------------------------------------------------------------------------


def _broken(spark, sf_dir):
    """Objects with holes: some nodes, ways and relations are missing."""
    key = F.col("id") - 1
    return t.objects(spark, sf_dir).where(~(((F.col("type") == "n") & (key % 10 == 3)) | ((F.col("type") == "w") & (key % 11 == 0)) | ((F.col("type") == "r") & (key % 13 == 0) & (key < 1_000_000))))


_BROKEN = """
, have AS (SELECT type, id FROM objs WHERE NOT ((type = 'n' AND (id - 1) % 10 = 3) OR (type = 'w' AND (id - 1) % 11 = 0) OR (type = 'r' AND (id - 1) % 13 = 0 AND id <= 1000000))),
lost AS (SELECT 'n' AS type, ref, 'w' AS parent_type, way AS parent_id FROM refs r WHERE way IN (SELECT id FROM have WHERE type = 'w') AND ref NOT IN (SELECT id FROM have WHERE type = 'n')
  UNION ALL SELECT m.type, m.ref, 'r', m.rel FROM members m WHERE m.rel IN (SELECT id FROM have WHERE type = 'r') AND NOT EXISTS (SELECT 1 FROM have h WHERE h.type = m.type AND h.id = m.ref))"""
_HAVE_COUNTS = "count(*) FILTER (type = 'n') AS nodes, count(*) FILTER (type = 'w') AS ways, count(*) FILTER (type = 'r') AS relations"


@query(_BROKEN + f" SELECT {_HAVE_COUNTS}, (SELECT count(*) FROM lost WHERE parent_type = 'w') AS missing_nodes_in_ways FROM have")
def check_refs_ways(spark, sf_dir):
    return rf.check_refs(_broken(spark, sf_dir))


@query(
    _BROKEN
    + f""" SELECT {_HAVE_COUNTS}, (SELECT count(*) FROM lost WHERE parent_type = 'w') AS missing_nodes_in_ways,
  (SELECT count(DISTINCT ref) FROM lost WHERE parent_type = 'r' AND type = 'n') AS missing_nodes_in_relations,
  (SELECT count(DISTINCT ref) FROM lost WHERE parent_type = 'r' AND type = 'w') AS missing_ways_in_relations,
  (SELECT count(*) FROM lost WHERE parent_type = 'r' AND type = 'r') AS missing_relations_in_relations FROM have"""
)
def check_refs_relations(spark, sf_dir):
    return rf.check_refs(_broken(spark, sf_dir), relations=True)


@query(
    _BROKEN
    + """, lines AS (SELECT DISTINCT type, ref, parent_type, parent_id FROM lost WHERE parent_type = 'w' OR type = 'r'
  UNION ALL SELECT type, ref, parent_type, min(parent_id) FROM lost WHERE parent_type = 'r' AND type <> 'r' GROUP BY ALL)
  SELECT type || ref || ' in ' || parent_type || parent_id AS line FROM lines"""
)
def check_refs_listing(spark, sf_dir):
    return rf.missing_ref_lines(_broken(spark, sf_dir)).select("line")


@query(" SELECT type, count(*) AS count, min(id) AS min_id, max(id) AS max_id FROM objs GROUP BY type")
def fileinfo_counts(spark, sf_dir):
    return sm.file_counts(t.objects(spark, sf_dir))


@query(""" SELECT (SELECT epoch(min(ts))::BIGINT FROM ways) AS first_timestamp, (SELECT epoch(max(ts))::BIGINT FROM ways) AS last_timestamp,
  min(lon)::INTEGER AS min_lon_e7, max(lon)::INTEGER AS max_lon_e7, min(lat)::INTEGER AS min_lat_e7, max(lat)::INTEGER AS max_lat_e7,
  true AS all_version, true AS some_version, false AS all_timestamp, true AS some_timestamp, false AS all_changeset, false AS some_changeset, false AS all_uid, true AS some_uid, false AS all_user, false AS some_user FROM nodes""")
def fileinfo_facts(spark, sf_dir):
    out = sm.file_facts(t.objects(spark, sf_dir))
    return out.withColumns({c: F.unix_timestamp(c) for c in ("first_timestamp", "last_timestamp")})


_ALL_TAGS = """
, tags AS (SELECT 'n' AS type, unnest(['brand', 'type', 'name']) AS k, unnest([brand, kind, name]) AS v FROM nodes UNION ALL SELECT 'w', unnest(['status', 'priority']), unnest([status, priority]) FROM ways
  UNION ALL SELECT 'r', unnest(['type', 'name']), unnest([kind, name]) FROM relations)"""


@query(_ALL_TAGS + " SELECT count(*) AS count, k AS key, NULL::VARCHAR AS value FROM tags GROUP BY k")
def tags_count_keys(spark, sf_dir):
    return sm.tags_count(t.objects(spark, sf_dir))


@query(_ALL_TAGS + " SELECT count(*) AS count, k AS key, v AS value FROM tags WHERE k = 'type' AND type <> 'w' GROUP BY k, v UNION ALL SELECT count(*), k, NULL FROM tags WHERE k IN ('brand', 'status') GROUP BY k")
def tags_count_tags(spark, sf_dir):
    return sm.tags_count(t.objects(spark, sf_dir), ["nr/type=*", "brand,status"])


@query(_ALL_TAGS + """ , counts AS (SELECT count(*) AS n, k, v FROM tags GROUP BY k, v HAVING count(*) BETWEEN 40 AND 1000)
  SELECT n || chr(9) || '"' || k || '"' || chr(9) || '"' || v || '"' AS line FROM counts""")
def tags_count_bounds(spark, sf_dir):
    return sm.count_lines(sm.tags_count(t.objects(spark, sf_dir), ["*=*"], 40, 1000))


# --- sorting and merging --------------------------------------------------------------------------


@query(""", rows AS (SELECT 'w' AS type, CASE WHEN id % 3 = 0 THEN -id ELSE id END AS id, 1 AS version FROM ways UNION ALL SELECT 'n', id, 1 FROM nodes)
  SELECT *, row_number() OVER (ORDER BY CASE type WHEN 'n' THEN 0 ELSE 1 END, CASE WHEN id > 0 THEN 1 ELSE 0 END, abs(id), version) AS position FROM rows""")
def sort_canonical(spark, sf_dir):
    from waymill.model import order_struct

    ways = t.ways(spark, sf_dir).withColumn("id", F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id")))
    every = mg.concatenate([ways, t.nodes(spark, sf_dir)])
    return numbered(every, order_struct()).select("type", "id", "version", "position")


# The later state of the ways and the change file of waymill.plans.tables.
_LATER = """
, later AS (SELECT id, CASE WHEN (id - 1) % 7 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN (id - 1) % 7 = 0 THEN uid + 1 WHEN (id - 1) % 13 = 0 THEN uid + 2 ELSE uid END AS uid, ts, refs FROM ways WHERE (id - 1) % 10 <> 0
  UNION ALL SELECT id + 10000000, 1, uid, ts, refs FROM ways WHERE (id - 1) % 50 = 1),
change AS (SELECT id, CASE WHEN (id - 1) % 3 = 0 THEN 0 ELSE 2 END AS version, (id - 1) % 8 <> 1 AS visible, uid + 5 AS uid, refs FROM ways WHERE (id - 1) % 4 = 1
  UNION ALL SELECT id + 10000000, 1, true, uid + 5, refs FROM ways WHERE (id - 1) % 50 = 1)"""


@query(_LATER + ", every AS (SELECT id, 1 AS version, uid, refs, 0 AS src FROM ways UNION ALL SELECT id, version, uid, refs, 1 FROM later) SELECT 'w' AS type, id, version, arg_max(uid, src)::INTEGER AS uid, arg_max(refs, src) AS refs FROM every GROUP BY id, version")
def merge(spark, sf_dir):
    return flat(mg.merge([t.ways(spark, sf_dir), t.later_ways(spark, sf_dir)]), "uid").drop("tags")


_TWO_CHANGES = _LATER + ", every AS (SELECT id, version, visible, uid, 0 AS src FROM change UNION ALL SELECT id, version, true, uid, 1 FROM later WHERE version = 2) "


def _two_changes(spark, sf_dir):
    return [t.changes(spark, sf_dir), t.later_ways(spark, sf_dir).where("version = 2")]


@query(_TWO_CHANGES + "SELECT 'w' AS type, id, version, visible, uid::INTEGER AS uid, src AS _src FROM every")
def merge_changes(spark, sf_dir):
    return mg.merge_changes(_two_changes(spark, sf_dir)).select("type", "id", "version", "visible", "uid", "_src")


@query(_TWO_CHANGES + "SELECT 'w' AS type, id, version, visible, uid::INTEGER AS uid, src AS _src FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, src DESC) AS n FROM every) WHERE n = 1")
def merge_changes_simplify(spark, sf_dir):
    return mg.merge_changes(_two_changes(spark, sf_dir), simplify=True).select("type", "id", "version", "visible", "uid", "_src")


# --- changes --------------------------------------------------------------------------------------

_WITH_CHANGES = _LATER + ", every AS (SELECT id, 1 AS version, true AS visible, uid, 0 AS src FROM ways UNION ALL SELECT id, version, visible, uid, 1 FROM change) "


@query(_WITH_CHANGES + "SELECT 'w' AS type, id, version, uid::INTEGER AS uid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, src DESC) AS n FROM every) WHERE n = 1 AND visible")
def apply_changes(spark, sf_dir):
    return ch.apply_changes(t.ways(spark, sf_dir), [t.changes(spark, sf_dir)]).select("type", "id", "version", "uid")


@query(_WITH_CHANGES + "SELECT 'w' AS type, id, version, visible, uid::INTEGER AS uid FROM every b WHERE src = 1 OR NOT EXISTS (SELECT 1 FROM change c WHERE c.id = b.id AND c.version = b.version)")
def apply_changes_history(spark, sf_dir):
    return ch.apply_changes_history(t.ways(spark, sf_dir), [t.changes(spark, sf_dir)]).select("type", "id", "version", "visible", "uid")


@query(_WITH_CHANGES + "SELECT 'w' AS type, id, version, visible, uid::INTEGER AS uid FROM every b WHERE src = 1 OR NOT EXISTS (SELECT 1 FROM change c WHERE c.id = b.id AND c.version = b.version)")
def apply_changes_redact(spark, sf_dir):
    changes = t.changes(spark, sf_dir).withColumn("timestamp", F.lit(None).cast("timestamp"))
    return ch.apply_changes_history(t.ways(spark, sf_dir), [changes], redact=True).select("type", "id", "version", "visible", "uid")


def _moved(spark, sf_dir):
    nodes = t.nodes(spark, sf_dir).where("id % 5 = 0")
    return nodes.withColumns({"version": F.lit(2), "lon_e7": (F.col("lon_e7") + 17).cast("int")})


_PLACED = "string_agg(r.ref || ':' || coalesce(n.lon::VARCHAR, '') || ':' || coalesce(n.lat::VARCHAR, ''), ',' ORDER BY r.pos)"


def _placed(ways: DataFrame) -> DataFrame:
    place = F.transform("refs", lambda r: F.concat_ws(":", r["ref"].cast("string"), F.coalesce(r["lon_e7"].cast("string"), F.lit("")), F.coalesce(r["lat_e7"].cast("string"), F.lit(""))))
    return ways.where("type = 'w'").select("id", F.array_join(place, ",").alias("refs"))


@query(f", n AS (SELECT id, CASE WHEN id % 5 = 0 THEN lon + 17 ELSE lon END AS lon, lat FROM nodes) SELECT w.id, coalesce((SELECT {_PLACED} FROM refs r LEFT JOIN n ON n.id = r.ref WHERE r.way = w.id), '') AS refs FROM ways w")
def apply_changes_locations(spark, sf_dir):
    located = lo.refreshed_locations(t.stored(spark, sf_dir))
    return _placed(ch.apply_changes_locations(located, [_moved(spark, sf_dir)]))


@query(_LATER + """SELECT 'w' AS type, id, version, true AS visible, uid::INTEGER AS uid FROM later l WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.id = l.id AND l.version = 1)
  UNION ALL SELECT 'w', id, 2, false, 0 FROM ways WHERE id NOT IN (SELECT id FROM later)""")
def derive_changes(spark, sf_dir):
    return ch.derive_changes(t.ways(spark, sf_dir), t.later_ways(spark, sf_dir), increment_version=True).select("type", "id", "version", "visible", "uid")


_DIFF = _LATER + """, compared AS (SELECT 'w' AS type, coalesce(o.id, l.id) AS id, coalesce(o.version, l.version) AS version,
  CASE WHEN l.id IS NULL THEN '-' WHEN o.id IS NULL THEN '+' WHEN o.uid = l.uid THEN ' ' ELSE '*' END AS status
  FROM (SELECT *, 1 AS version FROM ways) o FULL JOIN later l ON o.id = l.id AND o.version = l.version) """


@query(_DIFF + "SELECT status, type, id, version FROM compared")
def diff_status(spark, sf_dir):
    return ch.diff(t.ways(spark, sf_dir), t.later_ways(spark, sf_dir))


@query(_DIFF + "SELECT CASE WHEN status = '*' THEN ' ' ELSE status END || type || id || ' v' || version AS line FROM compared")
def diff_ignore_uid(spark, sf_dir):
    return ch.diff_lines(ch.diff(t.ways(spark, sf_dir), t.later_ways(spark, sf_dir), ignore=("uid",))).select("line")


@query(_DIFF + """SELECT count(*) FILTER (status = '-') AS "left", count(*) FILTER (status = '+') AS "right", count(*) FILTER (status = ' ') AS same, count(*) FILTER (status = '*') AS different FROM compared""")
def diff_summary(spark, sf_dir):
    return ch.diff_summary(ch.diff(t.ways(spark, sf_dir), t.later_ways(spark, sf_dir)))


# --- new ids, locations ---------------------------------------------------------------------------

# Ways only: their nodes dangle, so node ids come from references in the order of the ways.
_RANKS = ", node_map AS (SELECT ref AS old_id, row_number() OVER (ORDER BY min(way * 10000000 + pos)) AS new_id FROM refs GROUP BY ref) "


@query(_RANKS + "SELECT 'n' AS type, old_id, new_id FROM node_map UNION ALL SELECT 'w', id, -2 - row_number() OVER (ORDER BY id) FROM ways")
def renumber_nodes(spark, sf_dir):
    return rn.renumber_map(t.ways(spark, sf_dir), {"w": -3}, "nw")


@query(_RANKS + ", way_map AS (SELECT id, row_number() OVER (ORDER BY id) AS new_id FROM ways) SELECT 'w' AS type, m.new_id AS id, coalesce((SELECT string_agg(n.new_id::VARCHAR, ',' ORDER BY r.pos) FROM refs r JOIN node_map n ON n.old_id = r.ref WHERE r.way = m.id), '') AS refs FROM way_map m")
def renumber_refs(spark, sf_dir):
    ways = materialise(t.ways(spark, sf_dir), "ways")
    return flat(rn.renumber(ways, rn.renumber_map(ways))).select("type", "id", "refs")


@query(f" SELECT w.id, coalesce((SELECT {_PLACED} FROM refs r LEFT JOIN nodes n ON n.id = r.ref WHERE r.way = w.id), '') AS refs FROM ways w")
def add_locations(spark, sf_dir):
    return _placed(lo.add_locations(t.stored(spark, sf_dir)))


@query(" SELECT id, lon::INTEGER AS lon_e7, lat::INTEGER AS lat_e7 FROM nodes WHERE id IN (1, 17, 100)")
def locations_index_lookup(spark, sf_dir):
    return lo.lookup(lo.locations_index(t.nodes(spark, sf_dir)), [1, -17, 100, 900_000_000])


@query(" SELECT id, (CASE WHEN id % 5 = 0 THEN lon + 17 ELSE lon END)::INTEGER AS lon_e7, lat::INTEGER AS lat_e7 FROM nodes")
def locations_index_update(spark, sf_dir):
    return lo.locations_index(_moved(spark, sf_dir), before=lo.locations_index(t.nodes(spark, sf_dir)))


# --- extracts -------------------------------------------------------------------------------------

_BOX = Region.of_box((300_000_000, 200_000_000), (-500_000_000, -350_000_000))
_FAR_BOX = Region.of_box((900_000_000, 100_000_000), (1_700_000_000, 800_000_000))
_TRIANGLE = Region.of_polygons([[[(-1_000_500_000, -400_500_000), (1_200_500_000, -300_500_000), (100_500_000, 600_500_000)]]])


def _sets(inside: str) -> str:
    return f"""
, N AS ({inside}),
W AS (SELECT DISTINCT extract, way AS id FROM refs JOIN N ON N.id = ref),
R AS (SELECT DISTINCT extract, rel AS id FROM members m JOIN W ON m.type = 'w' AND W.id = m.ref),
Up AS (SELECT extract, id FROM R UNION SELECT u.extract, m.rel FROM Up u JOIN members m ON m.type = 'r' AND m.ref = u.id),
NW AS (SELECT DISTINCT extract, ref AS id FROM refs JOIN W ON W.id = way) """


_IN_BOX = "SELECT 'a' AS extract, id FROM nodes WHERE lon BETWEEN -500000000 AND 300000000 AND lat BETWEEN -350000000 AND 200000000"
_IN_FAR = "SELECT 'b' AS extract, id FROM nodes WHERE lon BETWEEN 900000000 AND 1700000000 AND lat BETWEEN 100000000 AND 800000000"
_WHOLE_WAYS = "SELECT extract, 'n' AS type, id FROM (SELECT * FROM N UNION SELECT * FROM NW) UNION ALL SELECT extract, 'w', id FROM W UNION ALL SELECT extract, 'r', id FROM Up"


@query(_sets(_IN_BOX) + "SELECT extract, 'n' AS type, id FROM N UNION ALL SELECT extract, 'w', id FROM W UNION ALL SELECT extract, 'r', id FROM R")
def extract_bbox_simple(spark, sf_dir):
    return xt.extract_ids(t.stored(spark, sf_dir), {"a": _BOX}, "simple")


@query(_sets(_IN_BOX) + _WHOLE_WAYS)
def extract_bbox_complete_ways(spark, sf_dir):
    return xt.extract(t.stored(spark, sf_dir), {"a": _BOX}).select("extract", "type", "id")


@query(_sets(_IN_BOX) + """, complete AS (SELECT R.extract, R.id FROM R JOIN relations USING (id) WHERE kind = 'multipolygon'),
  AW AS (SELECT extract, id FROM W UNION SELECT c.extract, m.ref FROM complete c JOIN members m ON m.rel = c.id AND m.type = 'w'),
  AN AS (SELECT * FROM N UNION SELECT extract, ref FROM refs JOIN AW ON AW.id = way)
  SELECT extract, 'n' AS type, id FROM AN UNION ALL SELECT extract, 'w', id FROM AW UNION ALL SELECT extract, 'r', id FROM Up""")
def extract_bbox_smart(spark, sf_dir):
    return xt.extract_ids(t.stored(spark, sf_dir), {"a": _BOX}, "smart")


@query(_sets("""SELECT 'a' AS extract, id FROM nodes WHERE
  ((lon - 1200500000)::HUGEINT * (-100000000) < (-2201000000)::HUGEINT * (lat + 300500000)) = false
  AND ((lon - 100500000)::HUGEINT * (-901000000) < 1100000000::HUGEINT * (lat - 600500000)) = false
  AND ((lon + 1000500000)::HUGEINT * 1001000000 > 1101000000::HUGEINT * (lat + 400500000))""") + _WHOLE_WAYS)
def extract_polygon(spark, sf_dir):
    return xt.extract_ids(t.stored(spark, sf_dir), {"a": _TRIANGLE})


@query(_sets(_IN_BOX + " UNION ALL " + _IN_FAR) + _WHOLE_WAYS)
def extract_multi(spark, sf_dir):
    return xt.extract_ids(t.stored(spark, sf_dir), {"a": _BOX, "b": _FAR_BOX})


# --- export ---------------------------------------------------------------------------------------


def _degrees(c: str, least: str = "") -> str:
    """A coordinate without needless zeros, in SQL."""
    whole = f"rtrim(printf('%.7f', {c} / 10000000.0), '0')"
    return f"CASE WHEN {whole} LIKE '%.' THEN {whole} || '{least}' ELSE {whole} END" if least else f"rtrim({whole}, '.')"


_LON, _LAT = _degrees("n.lon"), _degrees("n.lat")
_PATH = f"string_agg({_LON} || ' ' || {_LAT}, ',' ORDER BY r.pos)"
_ONLY = ("point",), ("linestring",), ("polygon",)


def _exported(spark, sf_dir, kinds, closed=True, **config) -> DataFrame:
    return ex.features(t.stored(spark, sf_dir, closed), ex.ExportConfig(geometry_types=kinds, **config))[0]


@query(f" SELECT 'n' || id AS feature_id, 'POINT(' || {_LON} || ' ' || {_LAT} || ')' AS geometry FROM nodes n")
def export_points(spark, sf_dir):
    return _exported(spark, sf_dir, _ONLY[0]).select("feature_id", ex.wkt().alias("geometry"))


@query(f""", shapes AS (SELECT way, 'LINESTRING(' || {_PATH} || ')' AS geometry, count(*) AS size FROM closed_refs r JOIN nodes n ON n.id = r.ref GROUP BY way)
  SELECT 'w' || way AS feature_id, geometry FROM shapes WHERE size >= 2""")
def export_lines(spark, sf_dir):
    return _exported(spark, sf_dir, _ONLY[1]).select("feature_id", ex.wkt().alias("geometry"))


_RULES = ex.ExportConfig(linear=ex._rule(["status=P"]), area=ex._rule(None))


@query(""", ends AS (SELECT way, count(*) AS n, arg_min(ref, pos) AS a, arg_max(ref, pos) AS b FROM closed_refs GROUP BY way),
  sited AS (SELECT e.way, e.n, (x.lon = y.lon AND x.lat = y.lat) AS closed FROM ends e JOIN nodes x ON x.id = e.a JOIN nodes y ON y.id = e.b)
  SELECT 'a' || (2 * way) AS feature_id, n::INTEGER AS points FROM sited JOIN ways ON ways.id = way WHERE closed AND n >= 4 AND status <> 'P'""")
def export_areas_closed_ways(spark, sf_dir):
    out = _exported(spark, sf_dir, _ONLY[2], linear=_RULES.linear, area=_RULES.area)
    return out.where("type = 'w'").select("feature_id", F.size(F.col("area")[0][0]).alias("points"))


@query(f""" SELECT '{{"type":"Feature","id":"n' || id || '","geometry":{{"type":"Point","coordinates":[' || {_degrees('n.lon', '0')} || ',' || {_degrees('n.lat', '0')} || ']}},"properties":{{"@version":1,"brand":"' || brand || '","name":"' || name || '"}}}}' AS json FROM nodes n""")
def export_geojson(spark, sf_dir):
    config = ex.read_config('{"attributes": {"version": true}, "exclude_tags": ["type"]}', geometry_types=("point",), unique_id="type_id")
    return ex.geojson_features(ex.features(t.nodes(spark, sf_dir), config)[0], config)


@query(f""" SELECT 'POINT(' || {_LON} || ' ' || {_LAT} || ') @type=node,@id=' || id || ',brand=' || brand || ',type=' || kind || ',name=' || name AS line FROM nodes n""")
def export_wkt(spark, sf_dir):
    config = ex.ExportConfig({"type": "@type", "id": "@id"}, geometry_types=("point",))
    return ex.text_features(ex.features(t.nodes(spark, sf_dir), config)[0], config)

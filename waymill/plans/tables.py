"""Map data made of the driver's order tables: parts are nodes, orders ways, customers, nations and regions relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.model import as_objects
from waymill.scratch import materialise

#: Nodes, ways and relations follow each other in the made file.
WAY_SEQ, RELATION_SEQ = 1_000_000_000_000, 2_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tags(**values) -> F.Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    lon = ((key * 7919) % 3600 - 1800) * 1_000_000
    lat = ((key * 104729) % 1800 - 900) * 1_000_000
    made = table(spark, sf_dir, "part").select(
        F.lit("n").alias("type"), (key + 1).alias("id"), F.lit(1).alias("version"), lon.cast("int").alias("lon_e7"), lat.cast("int").alias("lat_e7"),
        _tags(brand=F.col("p_brand"), type=F.col("p_type"), name=F.col("p_name")).alias("tags"), (key + 1).alias("_seq"),
    )
    return as_objects(made)


def ways(spark: SparkSession, sf_dir: str, closed: bool = False) -> DataFrame:
    """closed: every third way ends where it began. Lines of the same number and part give the same ref, so nothing more orders them."""
    line = F.struct("l_linenumber", "l_partkey")
    refs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    refs = refs.select("l_orderkey", F.transform("lines", lambda x: x["l_partkey"] + 1).alias("refs"))
    orders = table(spark, sf_dir, "orders").join(refs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ids = F.coalesce("refs", F.array().cast("array<bigint>"))
    if closed:
        ids = F.when((F.col("o_orderkey") % 3 == 0) & (F.size(ids) > 0), F.concat(ids, F.slice(ids, 1, 1))).otherwise(ids)
    made = orders.select(
        F.lit("w").alias("type"), (F.col("o_orderkey") + 1).alias("id"), F.lit(1).alias("version"), F.col("o_orderdate").alias("timestamp"), (F.col("o_custkey") + 1).alias("uid"),
        _tags(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("tags"),
        F.transform(ids, lambda r: F.struct(r.alias("ref"), F.lit(None).cast("int").alias("lon_e7"), F.lit(None).cast("int").alias("lat_e7"))).alias("refs"),
        (F.col("o_orderkey") + 1 + WAY_SEQ).alias("_seq"),
    )
    return as_objects(made)


def _relations(parents: DataFrame, children: DataFrame) -> DataFrame:
    """parents: id, kind, name; children: parent, type, ref."""
    member = F.struct(F.col("type"), F.col("ref"), F.lit("").alias("role"))
    grouped = children.groupBy("parent").agg(F.sort_array(F.collect_list(member)).alias("members"))
    rows = parents.join(grouped, F.col("id") == F.col("parent"), "left")
    members = F.coalesce("members", F.array().cast("array<struct<type:string,ref:bigint,role:string>>"))
    return as_objects(rows.select(F.lit("r").alias("type"), "id", F.lit(1).alias("version"), _tags(type=F.col("kind"), name=F.col("name")).alias("tags"), members.alias("members"), (F.col("id") + RELATION_SEQ).alias("_seq")))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    own = F.when(F.col("c_custkey") % 5 == 0, "multipolygon").otherwise("route")
    parents = customer.select((F.col("c_custkey") + 1).alias("id"), own.alias("kind"), F.col("c_mktsegment").alias("name"))
    parents = parents.unionByName(nation.select((F.col("n_nationkey") + 1_000_001).cast("bigint").alias("id"), F.lit("boundary").alias("kind"), F.col("n_name").alias("name")))
    parents = parents.unionByName(region.select((F.col("r_regionkey") + 2_000_001).cast("bigint").alias("id"), F.lit("site").alias("kind"), F.col("r_name").alias("name")))
    children = orders.select((F.col("o_custkey") + 1).alias("parent"), F.lit("w").alias("type"), (F.col("o_orderkey") + 1).alias("ref"))
    children = children.unionByName(customer.select((F.col("c_nationkey") + 1_000_001).cast("bigint").alias("parent"), F.lit("r").alias("type"), (F.col("c_custkey") + 1).alias("ref")))
    children = children.unionByName(nation.select((F.col("n_regionkey") + 2_000_001).cast("bigint").alias("parent"), F.lit("r").alias("type"), (F.col("n_nationkey") + 1_000_001).cast("bigint").alias("ref")))
    return _relations(parents, children)


def objects(spark: SparkSession, sf_dir: str, closed: bool = False) -> DataFrame:
    return nodes(spark, sf_dir).unionByName(ways(spark, sf_dir, closed)).unionByName(relations(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str, closed: bool = False) -> DataFrame:
    """The objects as a table of their own, for operators that pass over them several times."""
    return materialise(objects(spark, sf_dir, closed), "objects")


def later_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later state of the ways: some gone, some with a new version, some new."""
    old = ways(spark, sf_dir)
    key = F.col("id") - 1
    kept = old.where(key % 10 != 0).withColumn("version", F.when(key % 7 == 0, 2).otherwise(1))
    kept = kept.withColumn("uid", F.when(key % 7 == 0, F.col("uid") + 1).when(key % 13 == 0, F.col("uid") + 2).otherwise(F.col("uid")))
    new = old.where(key % 50 == 1).withColumn("id", F.col("id") + 10_000_000).withColumn("_seq", F.col("_seq") + 10_000_000)
    return kept.unionByName(new)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change file of ways: new versions, deletions, new ways, and versions older than the data's."""
    old = ways(spark, sf_dir)
    key = F.col("id") - 1
    changed = old.where(key % 4 == 1).withColumn("version", F.when(key % 3 == 0, 0).otherwise(2)).withColumn("visible", key % 8 != 1)
    new = old.where(key % 50 == 1).withColumn("id", F.col("id") + 10_000_000)
    return changed.unionByName(new).withColumn("uid", F.col("uid") + 5)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of nodes: the events of each user."""
    from pyspark.sql import Window

    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    made = table(spark, sf_dir, "events").select(F.lit("n").alias("type"), (F.col("user_id") + 1).alias("id"), version.alias("version"), (F.col("event_type") != "error").alias("visible"), F.col("ts").alias("timestamp"), _tags(event=F.col("event_type")).alias("tags"), F.col("event_id").alias("_seq"))
    return as_objects(made)


def changesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each user and day."""
    day = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.groupBy("user_id", day.alias("day")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("c"))
    user = F.col("user_id")
    lon, lat = ((user * 7919) % 3500 - 1800) * 1_000_000, ((user * 104729) % 1700 - 900) * 1_000_000
    boxed = lambda c: F.when(user % 7 != 0, c).cast("int")
    open_ = user % 10 == 0
    return rows.select(
        (user * 100_000 + F.col("day")).alias("id"), "created_at", F.when(~open_, F.col("last")).alias("closed_at"), open_.alias("open"), F.col("n").cast("int").alias("num_changes"), F.col("c").cast("int").alias("num_comments"),
        (user + 1).cast("int").alias("uid"), F.concat(F.lit("user"), user).alias("user"), boxed(lon).alias("min_lon_e7"), boxed(lat).alias("min_lat_e7"), boxed(lon + 100_000_000).alias("max_lon_e7"), boxed(lat + 100_000_000).alias("max_lat_e7"),
        F.array().cast("array<struct<k:string,v:string>>").alias("tags"),
    )


#: The same data in SQL: objs has a row for each object with its lists as text; refs and members a row for each entry.
PRELUDE = """
WITH RECURSIVE refs AS (
  SELECT l_orderkey + 1 AS way, l_partkey + 1 AS ref,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
closed_refs AS (
  SELECT way, ref, pos FROM refs UNION ALL SELECT way, ref, 1000000 FROM refs WHERE pos = 1 AND (way - 1) % 3 = 0),
members AS (
  SELECT o_custkey + 1 AS rel, 'w' AS type, o_orderkey + 1 AS ref FROM orders
  UNION ALL SELECT c_nationkey + 1000001, 'r', c_custkey + 1 FROM customer
  UNION ALL SELECT n_regionkey + 2000001, 'r', n_nationkey + 1000001 FROM nation),
nodes AS (
  SELECT p_partkey + 1 AS id, ((p_partkey * 7919) % 3600 - 1800) * 1000000 AS lon, ((p_partkey * 104729) % 1800 - 900) * 1000000 AS lat,
         p_brand AS brand, p_type AS kind, p_name AS name FROM part),
ways AS (
  SELECT o_orderkey + 1 AS id, o_orderdate AS ts, o_custkey + 1 AS uid, o_orderstatus AS status, o_orderpriority AS priority,
         coalesce((SELECT string_agg(ref::VARCHAR, ',' ORDER BY pos) FROM refs WHERE way = o_orderkey + 1), '') AS refs FROM orders),
relations AS (
  SELECT c_custkey + 1 AS id, CASE WHEN c_custkey % 5 = 0 THEN 'multipolygon' ELSE 'route' END AS kind, c_mktsegment AS name FROM customer
  UNION ALL SELECT n_nationkey + 1000001, 'boundary', n_name FROM nation
  UNION ALL SELECT r_regionkey + 2000001, 'site', r_name FROM region),
objs AS (
  SELECT 'n' AS type, id, 1 AS version, 'brand=' || brand || ';type=' || kind || ';name=' || name AS tags, '' AS refs FROM nodes
  UNION ALL SELECT 'w', id, 1, 'status=' || status || ';priority=' || priority, refs FROM ways
  UNION ALL SELECT 'r', id, 1, 'type=' || kind || ';name=' || name,
    coalesce((SELECT string_agg(m.type || m.ref, ',' ORDER BY m.type, m.ref) FROM members m WHERE m.rel = relations.id), '') FROM relations)
"""


def flat(df: DataFrame, *more: str) -> DataFrame:
    """Objects in plain columns: type, id, version, tags and refs as text, and others by name."""
    tags = F.array_join(F.transform("tags", lambda t: F.concat(t["k"], F.lit("="), t["v"])), ";")
    refs = F.array_join(F.col("refs.ref").cast("array<string>"), ",")
    members = F.array_join(F.transform("members", lambda m: F.concat(m["type"], m["ref"])), ",")
    text = F.coalesce(F.when(F.col("type") == "r", members).otherwise(refs), F.lit(""))
    return df.select("type", "id", "version", tags.alias("tags"), text.alias("refs"), *more)

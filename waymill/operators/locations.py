"""Node locations: on ways' refs, and as an index of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.operators.references import member_refs
from waymill.scratch import by_place

#: What stands for a missing number in the key of a row.
_NO_INT, _NO_LONG = -(1 << 31), -(1 << 63)


def node_locations(objects: DataFrame) -> DataFrame:
    """(id, lon_e7, lat_e7) of nodes with a location; of several rows for a node the last."""
    nodes = objects.where("type = 'n' and lon_e7 is not null and lat_e7 is not null")
    place = F.struct("_src", "_seq", "version")
    last = nodes.groupBy("id").agg(F.max_by(F.struct("lon_e7", "lat_e7"), place).alias("at"))
    return last.select("id", "at.lon_e7", "at.lat_e7")


def located_ways(ways: DataFrame, locations: DataFrame) -> DataFrame:
    """Ways with the locations found for their refs; other refs keep what they have.

    What goes to the locations and back is a ref's place and a location, both as plain numbers; the refs themselves
    stay with their way, which is moved with its ids and places as lists of numbers.
    """
    low = lambda c: F.coalesce(c, F.lit(_NO_INT)).cast("bigint")
    pack = lambda a, b: F.shiftleft(a, 32).bitwiseOR(b.bitwiseAND(F.lit(0xFFFFFFFF)))
    keyed = ways.withColumns({"__seq": F.coalesce("_seq", F.lit(_NO_LONG)), "__own": pack(low(F.col("version")), low(F.col("_src")))})
    key = ["id", "__seq", "__own"]
    refs = keyed.select(*key, F.posexplode("refs.ref").alias("pos", "node"))
    at = F.when(F.col("lon_e7").isNotNull() & F.col("lat_e7").isNotNull(), pack(F.col("lon_e7").cast("bigint"), F.col("lat_e7").cast("bigint")))
    found = refs.join(locations.select(F.col("id").alias("node"), at.alias("at")), "node", "left").select(*key, "pos", "at")
    lists = {f"__{c}": F.col(f"refs.{c}") for c in ("ref", "lon_e7", "lat_e7")}
    out = keyed.withColumns(lists).drop("refs").join(by_place(found, key, ["at"], "located"), key, "left")
    spot = lambda i: F.get("located", i)["at"]
    lon = lambda i: F.coalesce(F.shiftright(spot(i), 32).cast("int"), F.get("__lon_e7", i)).alias("lon_e7")
    lat = lambda i: F.coalesce(F.shiftright(F.shiftleft(spot(i), 32), 32).cast("int"), F.get("__lat_e7", i)).alias("lat_e7")
    placed = F.transform("__ref", lambda r, i: F.struct(r.alias("ref"), lon(i), lat(i)))
    return out.withColumn("refs", placed).select(*ways.columns)


def refreshed_locations(objects: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Ways' refs with the locations (id, lon_e7, lat_e7), by default of the objects' own nodes; those of unknown nodes keep what they have."""
    locations = node_locations(objects) if locations is None else locations
    return objects.where("type <> 'w'").unionByName(located_ways(objects.where("type = 'w'"), locations))


def add_locations(objects: DataFrame, keep_untagged: bool = False, keep_member_nodes: bool = False, ignore_missing: bool = False) -> DataFrame:
    """Ways' refs with node locations; nodes without tags go, unless kept or (if so wanted) members of relations.

    A ref to a node that isn't there raises an error when the result is computed, or with ignore_missing stays without.
    """
    out = refreshed_locations(objects)
    if not ignore_missing:
        lost = F.exists("refs", lambda r: r["lon_e7"].isNull())
        stop = F.raise_error(F.concat(F.lit("No location for a node of way "), F.col("id").cast("string")))
        out = out.withColumn("refs", F.when((F.col("type") == "w") & lost, stop.cast(objects.schema["refs"].dataType)).otherwise(F.col("refs")))
    if keep_untagged:
        return out
    needed = (F.col("type") != "n") | (F.size("tags") > 0)
    if not keep_member_nodes:
        return out.where(needed)
    members = member_refs(objects).where("type = 'n'").select("type", F.col("ref").alias("id"), F.lit(True).alias("__member")).distinct()
    return out.join(members, ["type", "id"], "left").where(needed | F.col("__member")).select(*objects.columns)


def locations_index(objects: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, lon_e7, lat_e7) by absolute node id; what is in the objects replaces what was in the index before."""
    new = node_locations(objects.withColumn("id", F.abs("id")))
    if before is None:
        return new
    return before.join(new, "id", "left_anti").select(*new.columns).unionByName(new)


def write_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sorted by id in files of ranges, so a lookup reads the statistics of all and the rows of few."""
    index.repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(index: DataFrame, ids: list[int]) -> DataFrame:
    """The locations of some ids; those that the index lacks are missing from the result."""
    return index.where(F.col("id").isin([abs(i) for i in ids]))


def location_of(index: DataFrame, node_id: int) -> tuple[int, int]:
    """The location of one node; KeyError if the index lacks it."""
    row = lookup(index, [node_id]).first()
    if row is None:
        raise KeyError(node_id)
    return row.lon_e7, row.lat_e7


def dump_index(index: DataFrame) -> DataFrame:
    """All nodes of an index in the order of their ids."""
    return index.select(F.lit("n").alias("type"), "id", "lon_e7", "lat_e7").orderBy("id")

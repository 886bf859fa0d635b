"""New ids in the order in which objects first appear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.model import TYPES
from waymill.scratch import by_place, materialise, numbered


def first_seen(objects: DataFrame, kind: str) -> DataFrame:
    """(id, place) of all ids of a type: objects by their place in the input, then ids that only
    ways, then that only relations refer to, by the place of the first reference."""
    own = objects.where(F.col("type") == kind).select("id", F.struct(F.lit(0).alias("phase"), "_src", "_seq", F.lit(0).alias("pos")).alias("place"))
    refs = None
    if kind == "n":
        refs = objects.where("type = 'w'").select("_src", "_seq", F.posexplode("refs.ref").alias("pos", "id"))
        refs = refs.select("id", F.struct(F.lit(1).alias("phase"), "_src", "_seq", "pos").alias("place"))
    members = objects.where("type = 'r'").select("_src", "_seq", F.posexplode("members").alias("pos", "m")).where(F.col("m.type") == kind)
    members = members.select(F.col("m.ref").alias("id"), F.struct(F.lit(2).alias("phase"), "_src", "_seq", "pos").alias("place"))
    every = own.unionByName(members) if refs is None else own.unionByName(refs).unionByName(members)
    return every.groupBy("id").agg(F.min("place").alias("place"))


def renumber_map(objects: DataFrame, starts: dict[str, int] | None = None, types: str = "nwr", before: DataFrame | None = None) -> DataFrame:
    """(type, old_id, new_id) for the types chosen.

    Ids count up from the type's start (default 1; 0 means 1), from a negative start down. With a
    map from before, its ids stay and new ones go on after them.
    """
    out = None
    for kind in TYPES:
        if kind not in types:
            continue
        start = (starts or {}).get(kind, 1) or 1
        seen = first_seen(objects, kind)
        known = 0
        if before is not None:
            mine = before.where(F.col("type") == kind)
            seen = seen.join(mine.select(F.col("old_id").alias("id")), "id", "left_anti")
            known = mine.count()
        rank = numbered(seen, [F.col("place")], "rank", known)
        new = F.lit(start) + F.col("rank") if start > 0 else F.lit(start) - F.col("rank")
        part = rank.select(F.lit(kind).alias("type"), F.col("id").alias("old_id"), new.cast("long").alias("new_id"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("No type to renumber")
    return out if before is None else before.select("type", "old_id", "new_id").unionByName(out)


def renumber(objects: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ids, refs and members rewritten by a map (type, old_id, new_id); what it lacks stays.

    Refs and members meet the map in one join and go back to their rows in one aggregate: what is asked for and
    answered is a place and an id, all else stays with the row.
    """
    mapping = materialise(mapping, "renumber-map")
    row = F.struct("type", "id", "version", "_src", "_seq").alias("row")
    entry = lambda kind, ref: F.struct(kind.alias("type"), ref.alias("old_id"))
    asked = F.when(F.col("type") == "w", F.transform("refs", lambda r: entry(F.lit("n"), r["ref"]))).otherwise(F.transform("members", lambda m: entry(m["type"], m["ref"])))
    entries = objects.where("type in ('w', 'r')").select(row, F.posexplode(asked).alias("pos", "e"))
    found = entries.select("row", "pos", "e.*").join(mapping, ["type", "old_id"], "left").select("row", "pos", "new_id")
    lists = by_place(found, "row", ["new_id"], "__new")
    own = objects.join(mapping.withColumnRenamed("old_id", "id"), ["type", "id"], "left").withColumn("row", row)
    out = own.join(lists, "row", "left")
    new = lambda ref, i: F.coalesce(F.get("__new", i)["new_id"], ref)
    refs = F.transform("refs", lambda r, i: F.struct(new(r["ref"], i).alias("ref"), r["lon_e7"].alias("lon_e7"), r["lat_e7"].alias("lat_e7")))
    members = F.transform("members", lambda m, i: F.struct(m["type"].alias("type"), new(m["ref"], i).alias("ref"), m["role"].alias("role")))
    asked_for = F.col("__new").isNotNull()
    out = out.withColumns({"id": F.coalesce("new_id", "id"), "refs": F.when((F.col("type") == "w") & asked_for, refs).otherwise(F.col("refs")), "members": F.when((F.col("type") == "r") & asked_for, members).otherwise(F.col("members"))})
    return out.select(*objects.columns)

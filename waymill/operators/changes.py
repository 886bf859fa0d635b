"""Change sets: applying them, deriving them, and comparing two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.operators.locations import located_ways, node_locations
from waymill.operators.merging import concatenate, latest
from waymill.operators.references import KEY
from waymill.scratch import materialise

_CONTENT = ("version", "visible", "timestamp", "changeset", "uid", "user", "tags", "lon_e7", "lat_e7", "refs", "members")


def apply_changes(objects: DataFrame, changes: list[DataFrame]) -> DataFrame:
    """The latest version of every object of data and changes; gone if that is deleted.

    At the same version and time a change beats the data, a later change an earlier one.
    """
    return latest(concatenate([objects, *changes])).where("visible")


def apply_changes_history(history: DataFrame, changes: list[DataFrame], redact: bool = False) -> DataFrame:
    """All versions of history and changes; of one in both the change's row.

    Versions are the same by type, id, version and time, with redact by type, id and version.
    """
    new = concatenate(changes)
    key = [*KEY, "version"] if redact else [*KEY, "version", "timestamp"]
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    keys = new.select(*key).distinct()
    kept = history.alias("o").join(keys.alias("c"), same, "left_anti")
    return kept.withColumn("_src", F.lit(-1)).unionByName(new)


def apply_changes_locations(objects: DataFrame, changes: list[DataFrame]) -> DataFrame:
    """As apply_changes, for ways that carry locations: their refs get the nodes' new ones.

    A location comes from the nodes of the changes, whatever their version (of several the last in the
    order of the changes); else, for nodes of ways in the changes, from the data's. Other refs keep their own.
    """
    new = concatenate(changes)
    changed = node_locations(new)
    needed = new.where("type = 'w'").select(F.explode("refs.ref").alias("id")).distinct()
    rest = node_locations(objects).join(needed, "id", "left_semi").join(changed, "id", "left_anti")
    out = apply_changes(objects, changes)
    ways = materialise(out.where("type = 'w'"), "changed-ways")  # they are asked for their refs and for themselves
    return out.where("type <> 'w'").unionByName(located_ways(ways, changed.unionByName(rest)))


def derive_changes(old: DataFrame, new: DataFrame, increment_version: bool = False, keep_details: bool = False, update_timestamp: Column | None = None) -> DataFrame:
    """What turns old into new: versions that old doesn't have, and a deletion of each object that new doesn't have.

    A deletion has the object's id, version and time only, unless keep_details; its
    version can be counted up and its time set.
    """
    fresh = new.join(old.select(*KEY, "version"), [*KEY, "version"], "left_anti").select(*new.columns)
    gone = latest(old).join(new.select(*KEY), KEY, "left_anti").select(*old.columns).withColumn("visible", F.lit(False))
    if not keep_details:
        empty = {"changeset": F.lit(0), "uid": F.lit(0), "user": F.lit(""), "tags": F.slice("tags", 1, 0), "lon_e7": F.lit(None), "lat_e7": F.lit(None)}
        empty |= {"refs": F.slice("refs", 1, 0), "members": F.slice("members", 1, 0)}
        gone = gone.withColumns({k: v.cast(old.schema[k].dataType) for k, v in empty.items()})
    if increment_version:
        gone = gone.withColumn("version", F.col("version") + 1)
    if update_timestamp is not None:
        gone = gone.withColumn("timestamp", update_timestamp.cast("timestamp"))
    return fresh.unionByName(gone)


def diff(old: DataFrame, new: DataFrame, ignore: tuple[str, ...] = (), keep_rows: bool = False) -> DataFrame:
    """(status, type, id, version) of each version in old (-), new (+) or both: blank if alike, * if not.

    ignore: attributes of changeset, uid and user that don't matter. Two rows are alike if all
    else is, tags, refs and members in their order; missing values equal each other. keep_rows
    adds both rows as structs old and new.
    """
    compared = [c for c in _CONTENT if c != "version" and c not in ignore]
    key = [*KEY, "version"]
    left = old.select(*key, F.struct(*(old.columns if keep_rows else compared)).alias("old"))
    right = new.select(*key, F.struct(*(new.columns if keep_rows else compared)).alias("new"))
    alike = F.lit(True)
    for c in compared:
        alike = alike & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    status = F.when(F.col("new").isNull(), "-").when(F.col("old").isNull(), "+").when(alike, " ").otherwise("*")
    out = left.join(right, key, "full_outer").withColumn("status", status)
    return out.select("status", *key, *(["old", "new"] if keep_rows else []))


def diff_summary(compared: DataFrame) -> DataFrame:
    """One row: how many versions are only in old or new, alike, or different."""
    names = (("-", "left"), ("+", "right"), (" ", "same"), ("*", "different"))
    return compared.agg(*[F.count_if(F.col("status") == s).alias(name) for s, name in names])


def diff_lines(compared: DataFrame) -> DataFrame:
    """Compact lines: status, type and id, version."""
    return compared.withColumn("line", F.concat("status", "type", "id", F.lit(" v"), "version"))


def identical(compared: DataFrame) -> bool:
    """Whether nothing differs."""
    return compared.where("status <> ' '").isEmpty()

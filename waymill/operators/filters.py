"""Rows by type, tags, changeset properties and time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymill.functions.tags import TagFilter, tag_filter
from waymill.model import is_area_like
from waymill.operators.references import KEY, closure, first_occurrences, member_refs, node_refs, relation_edges
from waymill.scratch import materialise


def of_types(objects: DataFrame, types: str) -> DataFrame:
    """Objects of the types whose letters are given."""
    return objects.where(F.col("type").isin(*types))


def matches(filters: list[TagFilter]) -> Column:
    """Whether an object has a tag that one of the filters for its type (or, if it is an area, for areas) fits."""
    found = F.lit(False)
    for letter in "nwr":
        for f in filters:
            if letter in f.types:
                found = found | ((F.col("type") == letter) & f.matcher.any_of())
    for f in filters:
        if "a" in f.types:
            found = found | (is_area_like() & f.matcher.any_of())
    return found


def tags_filter(objects: DataFrame, expressions: list[str], invert: bool = False, add_referenced: bool = True, remove_tags: bool = False) -> DataFrame:
    """Objects that fit an expression (see tag_filter), with invert all others.

    With add_referenced also what these need: relations' members at any depth, ways' nodes;
    remove_tags empties the tags of those that are given only for that.
    """
    hit = F.coalesce(matches([tag_filter(e) for e in expressions]), F.lit(False))
    flagged = objects.withColumn("__hit", ~hit if invert else hit)
    if not add_referenced:
        return flagged.where("__hit").drop("__hit")
    seeds = materialise(flagged.where("__hit and type <> 'n'").select(*KEY).distinct(), "matching-ids")
    deep = closure(seeds.where("type = 'r'").select("id"), relation_edges(objects))
    members = member_refs(objects).join(deep, "id", "left_semi").select("type", F.col("ref").alias("id")).distinct()
    members = materialise(members, "member-ids")
    ways = seeds.where("type = 'w'").select("id").union(members.where("type = 'w'").select("id")).distinct()
    nodes = node_refs(objects).join(ways, "id", "left_semi").select(F.lit("n").alias("type"), F.col("ref").alias("id"))
    needed = members.union(nodes).distinct().withColumn("__needed", F.lit(True))
    out = flagged.join(needed, KEY, "left").where("__hit or __needed")
    if remove_tags:
        out = out.withColumn("tags", F.when(F.col("__hit"), F.col("tags")).otherwise(F.slice("tags", 1, 0)))
    return out.drop("__hit", "__needed").select(*objects.columns)


def changeset_filter(
    changesets: DataFrame,
    with_discussion: bool | None = None,
    with_changes: bool | None = None,
    open_: bool | None = None,
    uid: int | None = None,
    user: str | None = None,
    after: datetime | None = None,
    before: datetime | None = None,
    bbox: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Changesets that meet all conditions that are given.

    with_discussion, with_changes, open_: True for some, False for none. after: open, or
    closed then or later. before: created then or earlier. bbox (min lon, min lat, max lon,
    max lat in 1e-7 degrees): overlaps; changesets without a box don't.
    """
    c = F.col
    tests: list[Column] = []
    if with_discussion is not None:
        tests.append((c("num_comments") > 0) == F.lit(with_discussion))
    if with_changes is not None:
        tests.append((c("num_changes") > 0) == F.lit(with_changes))
    if open_ is not None:
        tests.append(c("closed_at").isNull() == F.lit(open_))
    if uid is not None:
        tests.append(c("uid") == uid)
    if user is not None:
        tests.append(c("user") == user)
    if after is not None:
        tests.append(c("closed_at").isNull() | (c("closed_at") >= F.lit(after)))
    if before is not None:
        tests.append(c("created_at") <= F.lit(before))
    if bbox is not None:
        a, b, x, y = bbox
        tests.append((c("min_lon_e7") <= x) & (c("max_lon_e7") >= a) & (c("min_lat_e7") <= y) & (c("max_lat_e7") >= b))
    for test in tests:
        changesets = changesets.where(test)
    return changesets


def with_validity(history: DataFrame) -> DataFrame:
    """Each version with the time of the next, until; null for the last."""
    versions = Window.partitionBy(*KEY).orderBy("version", "_src", "_seq")
    return history.withColumn("until", F.lead("timestamp").over(versions))


def time_filter(history: DataFrame, start: datetime, end: datetime | None = None) -> DataFrame:
    """What was there at a point in time, without deleted objects; with end, all versions valid in [start, end)."""
    valid = with_validity(history)
    begun, until = F.col("timestamp"), F.col("until")
    if end is None:
        kept = (begun <= F.lit(start)) & (until.isNull() | (until > F.lit(start))) & F.col("visible")
    else:
        at_once = begun == until
        kept = (begun < F.lit(end)) & F.when(at_once, until >= F.lit(start)).otherwise(until.isNull() | (until > F.lit(start)))
    return valid.where(kept).drop("until")


def unique_objects(objects: DataFrame) -> DataFrame:
    """The first row of each object."""
    return first_occurrences(objects)

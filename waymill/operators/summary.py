"""Counts and facts about a whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.functions.tags import any_match, tag_filter
from waymill.model import order_struct
from waymill.scratch import adjacent_pairs

SORTS = {"count": "count-desc", "name": "name-asc"}


def tags_count(objects: DataFrame, expressions: list[str] | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """(count, key, value) of tags: by key for expressions without ``=``, by key and value for those with.

    Without expressions all keys are counted. Only tags of objects of an expression's types count.
    least, most: bounds on the count, both inclusive. value is null where keys are counted.
    """
    filters = [tag_filter(e) for e in expressions or ["*"]]
    tags = objects.select("type", F.explode("tags").alias("t"))

    def hits(with_value: bool) -> Column:
        found = F.lit(False)
        for letter in "nwr":
            mine = [f.matcher for f in filters if letter in f.types and (f.matcher.value is not None) == with_value]
            if mine:
                found = found | ((F.col("type") == letter) & any_match(mine, F.col("t")))
        return found

    # One pass: a tag that is counted both ways gives two rows.
    kinds = F.array_compact(F.array(F.when(hits(False), F.struct(F.col("t.k").alias("key"), F.lit(None).cast("string").alias("value"))), F.when(hits(True), F.struct(F.col("t.k").alias("key"), F.col("t.v").alias("value")))))
    counts = tags.select(F.explode(kinds).alias("c")).select("c.*").groupBy("key", "value").agg(F.count("*").alias("count"))
    if least is not None:
        counts = counts.where(F.col("count") >= least)
    if most is not None:
        counts = counts.where(F.col("count") <= most)
    return counts.select("count", "key", "value")


def sorted_counts(counts: DataFrame, by: str = "count-desc") -> DataFrame:
    """In the order count-desc, count-asc, name-asc or name-desc; a bare key comes before its values."""
    by = SORTS.get(by, by)
    up, down = [F.col("key").asc(), F.col("value").asc_nulls_first()], [F.col("key").desc(), F.col("value").desc_nulls_last()]
    orders = {"count-desc": [F.col("count").desc(), *up], "count-asc": [F.col("count").asc(), *up], "name-asc": up, "name-desc": down}
    if by not in orders:
        raise ValueError(f"Unknown order {by!r}; known: {', '.join(orders)}")
    return counts.orderBy(*orders[by])


def count_lines(counts: DataFrame) -> DataFrame:
    """As lines: count, key and value with tabs between, names in doubled quotes."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return counts.select(F.concat_ws("\t", F.col("count").cast("string"), quoted("key"), quoted("value")).alias("line"))


def file_counts(objects: DataFrame) -> DataFrame:
    """(type, count, min_id, max_id) for each of n, w, r; ids 0 where there is none."""
    every = objects.sparkSession.createDataFrame([("n",), ("w",), ("r",)], "type string")
    found = objects.groupBy("type").agg(F.count("*").alias("count"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
    return every.join(found, "type", "left").select("type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "min_id", "max_id")])


def file_facts(objects: DataFrame) -> DataFrame:
    """One row: times, box of the nodes, and of five attributes whether all or some objects have them."""
    has = {
        "version": F.col("version") > 0,
        "timestamp": F.col("timestamp").isNotNull(),
        "changeset": F.col("changeset") > 0,
        "uid": F.col("uid") > 0,
        "user": F.col("user") != "",
    }
    facts = [F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp")]
    for c in ("lon_e7", "lat_e7"):
        node = F.when(F.col("type") == "n", F.col(c))
        facts += [F.min(node).alias(f"min_{c}"), F.max(node).alias(f"max_{c}")]
    for name, column in has.items():
        facts += [F.coalesce(F.bool_and(column), F.lit(True)).alias(f"all_{name}"), F.coalesce(F.bool_or(column), F.lit(False)).alias(f"some_{name}")]
    return objects.agg(*facts)


def order_facts(objects: DataFrame) -> DataFrame:
    """One row: whether the rows are in canonical order, and whether some object has several versions (null if not ordered)."""
    rank, signed, size, version = order_struct()[:4]
    value = F.struct(rank.alias("rank"), signed.alias("sign"), size.alias("size"), version.alias("version"))
    pairs = adjacent_pairs(objects, ["_src", "_seq"], value)
    same = (F.col("before.rank") == F.col("here.rank")) & (F.col("before.sign") == F.col("here.sign")) & (F.col("before.size") == F.col("here.size"))
    both = pairs.agg(F.coalesce(F.bool_and(F.col("before") <= F.col("here")), F.lit(True)).alias("ordered"), F.coalesce(F.bool_or(same), F.lit(False)).alias("several"))
    return both.select("ordered", F.when(F.col("ordered"), F.col("several")).alias("multiple_versions"))


def fingerprint(objects: DataFrame) -> DataFrame:
    """One row: a hash of all rows that doesn't depend on their order."""
    row = F.xxhash64(*[c for c in objects.columns if c not in ("_src", "_seq")])
    return objects.agg(F.bit_xor(row).alias("fingerprint"), F.count("*").alias("rows"))

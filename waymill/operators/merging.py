"""Several inputs as one: concatenation, sorting, merging, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill.model import Dataset, Header, canonical_order, order_struct
from waymill.operators.references import KEY
from waymill.scratch import adjacent_pairs

#: What an attribute is when it is unset.
_UNSET = {"version": (0, "int"), "changeset": (0, "bigint"), "timestamp": (None, "timestamp"), "uid": (0, "int"), "user": ("", "string")}


def clean(objects: DataFrame, attributes: list[str]) -> DataFrame:
    """Unset some of version, changeset, timestamp, uid and user."""
    unknown = set(attributes) - set(_UNSET)
    if unknown:
        raise ValueError(f"Unknown attribute {min(unknown)!r}; known: {', '.join(_UNSET)}")
    return objects.withColumns({a: F.lit(_UNSET[a][0]).cast(_UNSET[a][1]) for a in attributes})


def concatenate(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs; _src becomes the place of the input."""
    return reduce(DataFrame.unionByName, [df.withColumn("_src", F.lit(i)) for i, df in enumerate(inputs)])


def sort_objects(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs in canonical order; nothing is dropped."""
    return concatenate(inputs).orderBy(*canonical_order())


def sort_datasets(inputs: list[Dataset]) -> Dataset:
    """Sorted rows with one header: the first one's options, a box around all boxes, and the sorting."""
    boxes = tuple(b for d in inputs for b in d.header.boxes)
    box = Header(boxes=boxes).joined_box()
    header = Header(dict(inputs[0].header.options) | {"sorting": "Type_then_ID"}, (box,) if box else ())
    return Dataset(sort_objects([d.df for d in inputs]), header, inputs[0].kind)


def latest(objects: DataFrame) -> DataFrame:
    """The last version of each object; of equal versions the later time, then the later input."""
    newest = Window.partitionBy(*KEY).orderBy(F.col("version").desc(), F.col("timestamp").desc_nulls_last(), F.col("_src").desc(), F.col("_seq").desc())
    return objects.withColumn("__nth", F.row_number().over(newest)).where("__nth = 1").drop("__nth")


def merge(inputs: list[DataFrame]) -> DataFrame:
    """One row for each (type, id, version) of all inputs, the later input's; a single input is given as it is."""
    if len(inputs) == 1:
        return concatenate(inputs)
    last = Window.partitionBy(*KEY, "version").orderBy(F.col("_src").desc(), F.col("_seq").desc())
    return concatenate(inputs).withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth")


def merge_changes(inputs: list[DataFrame], simplify: bool = False) -> DataFrame:
    """All rows of all change files; simplify keeps the last version of each object, deleted or not."""
    rows = concatenate(inputs)
    return latest(rows) if simplify else rows


def order_errors(objects: DataFrame) -> DataFrame:
    """(_src, kind, count) of rows that break the order of their input: by type, id or version, or the same version twice."""
    rank, signed, size, version = order_struct()[:4]
    value = F.struct("_src", rank.alias("rank"), F.struct(signed.alias("sign"), size.alias("size")).alias("id"), version.alias("version"))
    pairs = adjacent_pairs(objects, ["_src", "_seq"], value).where("before._src = here._src")
    kind = (
        F.when(F.col("before.rank") > F.col("here.rank"), "type")
        .when(F.col("before.rank") < F.col("here.rank"), None)
        .when(F.col("before.id") > F.col("here.id"), "id")
        .when(F.col("before.id") < F.col("here.id"), None)
        .when(F.col("before.version") > F.col("here.version"), "version")
        .when(F.col("before.version") == F.col("here.version"), "same version")
    )
    return pairs.select(F.col("here._src").alias("_src"), kind.alias("kind")).where("kind is not null").groupBy("_src", "kind").count()

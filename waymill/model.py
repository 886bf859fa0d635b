"""Map data as DataFrames: nodes, ways and relations in one table, changesets in another."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAGS = T.ArrayType(T.StructType().add("k", "string").add("v", "string"))
_REFS = T.ArrayType(T.StructType().add("ref", "long").add("lon_e7", "integer").add("lat_e7", "integer"))
_MEMBERS = T.ArrayType(T.StructType().add("type", "string").add("ref", "long").add("role", "string"))


def _schema(*fields: tuple) -> T.StructType:
    out = T.StructType()
    for name, kind in fields:
        out = out.add(name, kind)
    return out


OBJECTS = _schema(
    ("type", "string"), ("id", "long"), ("version", "integer"), ("visible", "boolean"), ("timestamp", "timestamp"), ("changeset", "long"), ("uid", "integer"), ("user", "string"),
    ("tags", _TAGS), ("lon_e7", "integer"), ("lat_e7", "integer"), ("refs", _REFS), ("members", _MEMBERS), ("_src", "integer"), ("_seq", "long"),
)
CHANGESETS = _schema(
    ("id", "long"), ("created_at", "timestamp"), ("closed_at", "timestamp"), ("open", "boolean"), ("num_changes", "integer"), ("num_comments", "integer"), ("uid", "integer"), ("user", "string"),
    ("min_lon_e7", "integer"), ("min_lat_e7", "integer"), ("max_lon_e7", "integer"), ("max_lat_e7", "integer"), ("tags", _TAGS),
)
TYPES = ("n", "w", "r")
TYPE_NAMES = {"n": "node", "w": "way", "r": "relation"}
TAGS = "array<struct<k:string,v:string>>"


@dataclass(frozen=True)
class Header:
    """What a file says about itself: options in order, bounding boxes (min lon, min lat, max lon, max lat in 1e-7 degrees)."""

    options: dict[str, str] = field(default_factory=dict)
    boxes: tuple[tuple[int, int, int, int], ...] = ()

    def merged(self, settings: list[str], source: Header | None = None) -> Header:
        """With ``name=value`` settings; ``name!`` takes the value of source, ``!name``-less others stay."""
        options = dict(self.options)
        for setting in settings:
            if setting.endswith("!") and "=" not in setting:
                name = setting[:-1]
                if source and name in source.options:
                    options[name] = source.options[name]
            else:
                name, _, value = setting.partition("=")
                if not name:
                    raise ValueError(f"Header setting without a name: {setting!r}")
                options[name] = value
        return replace(self, options=options)

    def joined_box(self) -> tuple[int, int, int, int] | None:
        """The box around all boxes."""
        if not self.boxes:
            return None
        a, b, c, d = zip(*self.boxes, strict=True)
        return min(a), min(b), max(c), max(d)


@dataclass(frozen=True)
class Dataset:
    """Objects with their header. kind: data (one version each), history or change."""

    df: DataFrame
    header: Header = Header()
    kind: str = "data"


def type_rank(kind: Column | str = "type") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind == "n", 0).when(kind == "w", 1).otherwise(2)


def canonical_order(src: bool = True) -> list[Column]:
    """Node, way, relation; then ids up to 0 before positive ones, each by size; then version and time.

    Missing timestamps come last. Rows alike in all of that keep the order of the input.
    """
    keys = [type_rank(), F.when(F.col("id") > 0, 1).otherwise(0), F.abs("id"), F.col("version"), F.col("timestamp").asc_nulls_last()]
    return keys + ([F.col("_src"), F.col("_seq")] if src else [])


def order_struct() -> list[Column]:
    """The canonical order as plain values, all ascending."""
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")
    return [type_rank(), F.when(F.col("id") > 0, 1).otherwise(0), F.abs("id"), F.col("version"), F.coalesce("timestamp", far), F.col("_src"), F.col("_seq")]


def as_objects(df: DataFrame, src: int = 0) -> DataFrame:
    """Any columns brought to the schema; missing ones get what an unset attribute has."""
    unset = {"version": F.lit(0), "visible": F.lit(True), "changeset": F.lit(0), "uid": F.lit(0), "user": F.lit(""), "tags": F.array().cast(TAGS), "_src": F.lit(src), "_seq": F.col("id")}
    out = []
    for f in OBJECTS.fields:
        if f.name in df.columns:
            column = F.coalesce(F.col(f.name), unset[f.name]) if f.name in unset else F.col(f.name)
        else:
            column = unset.get(f.name, F.lit(None))
        out.append(column.cast(f.dataType).alias(f.name))
    return df.select(*out)


def tag_value(key: str) -> Column:
    """The value of the first tag of that key, or null."""
    return F.get(F.filter("tags", lambda t: t["k"] == key), F.lit(0))["v"]


def is_area_like() -> Column:
    """A way of four or more refs that ends where it began, or a multipolygon or boundary relation."""
    n = F.size("refs")
    closed = (n >= 4) & (F.get("refs", F.lit(0))["ref"] == F.get("refs", n - 1)["ref"])
    kind = tag_value("type").isin("multipolygon", "boundary")
    return F.when(F.col("type") == "w", closed).when(F.col("type") == "r", kind).otherwise(False)

"""Objects as features: points, lines and areas with attributes and tags, and their text forms."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.functions.geometry import assemble, counter_clockwise, ewkb_column, point_list
from waymill.functions.tags import TagMatcher, any_match, tag_matcher
from waymill.model import TYPE_NAMES, TYPES
from waymill.operators.locations import located_ways, node_locations
from waymill.scratch import materialise, numbered

ATTRIBUTES = ("type", "id", "version", "changeset", "uid", "user", "timestamp", "way_nodes")
_POINT = "struct<lon_e7:int,lat_e7:int>"
_AREA = f"array<array<array<{_POINT}>>>"
_AREA_ARROW = pa.list_(pa.list_(pa.list_(pa.struct([("lon_e7", pa.int32()), ("lat_e7", pa.int32())]))))


@dataclass(frozen=True)
class Rule:
    """Which tagged closed ways are lines, or areas. kind: none, any, list (a tag fits), other (none fits the other list)."""

    kind: str = "any"
    matchers: tuple[TagMatcher, ...] = ()

    def fits(self, other: Rule) -> Column:
        if self.kind == "none":
            return F.lit(False)
        if self.kind == "any":
            return F.size("tags") > 0
        if self.kind == "list":
            return F.exists("tags", lambda t: any_match(list(self.matchers), t))
        return ~F.exists("tags", lambda t: any_match(list(other.matchers), t))


@dataclass(frozen=True)
class ExportConfig:
    """attributes: output name of each attribute that is wanted. include/exclude: tags in the output, one of the two at most.

    object_types: of which objects features and errors are wanted.
    """

    attributes: dict[str, str] = field(default_factory=dict)
    linear: Rule = Rule()
    area: Rule = Rule()
    include_tags: tuple[TagMatcher, ...] = ()
    exclude_tags: tuple[TagMatcher, ...] = ()
    keep_untagged: bool = False
    geometry_types: tuple[str, ...] = ("point", "linestring", "polygon")
    object_types: tuple[str, ...] = TYPES
    unique_id: str | None = None
    format_options: dict = field(default_factory=dict)


def _rule(value) -> Rule:
    if value is None:
        return Rule("other")
    if isinstance(value, bool):
        return Rule("any" if value else "none")
    if not isinstance(value, list):
        raise ValueError("linear_tags and area_tags are true, false, null or a list")
    return Rule("list", tuple(map(tag_matcher, value))) if value else Rule("any")


def read_config(text: str, **overrides) -> ExportConfig:
    """From the JSON of a configuration file."""
    given = json.loads(text) if text.strip() else {}
    linear, area = _rule(given.get("linear_tags")), _rule(given.get("area_tags"))
    if linear.kind == area.kind == "other":
        linear = area = Rule("any")
    attributes = {}
    for name, value in given.get("attributes", {}).items():
        if name not in ATTRIBUTES:
            raise ValueError(f"Unknown attribute {name!r}")
        if value:
            attributes[name] = f"@{name}" if value is True else value
    include, exclude = (tuple(map(tag_matcher, given.get(k) or [])) for k in ("include_tags", "exclude_tags"))
    if include and exclude:
        raise ValueError("Either include_tags or exclude_tags")
    return ExportConfig(attributes, linear, area, include, exclude, format_options=given.get("format_options", {}), **overrides)


def line_and_area(config: ExportConfig) -> tuple[Column, Column]:
    """Whether a closed way is a line, and whether it is an area: by an area tag of yes or no, else by the rules."""
    said = F.get(F.filter("tags", lambda t: t["k"] == "area"), F.lit(0))["v"]
    line = F.when(said == "no", True).when(said == "yes", False).otherwise(config.linear.fits(config.area))
    area = F.when(said == "no", False).when(said == "yes", True).otherwise(config.area.fits(config.linear))
    return line, area


def _points(refs: Column) -> Column:
    return F.transform(refs, lambda r: F.struct(r["lon_e7"].alias("lon_e7"), r["lat_e7"].alias("lat_e7")))


_COMMON = ["type", "id", "version", "changeset", "uid", "user", "timestamp", "tags", "refs"]


def _feature(df: DataFrame, kind: Column, feature: Column, points: Column | None = None, area: Column | None = None) -> DataFrame:
    empty_points, empty_area = F.lit(None).cast(f"array<{_POINT}>"), F.lit(None).cast(_AREA)
    return df.select(*_COMMON, kind.alias("geometry_type"), feature.alias("feature_id"), (empty_points if points is None else points).alias("points"), (empty_area if area is None else area).alias("area"))


def _area_relations(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multipolygon and boundary relations, and (id, pos, way) of their ways."""
    kind = F.get(F.filter("tags", lambda t: t["k"] == "type"), F.lit(0))["v"]
    relations = objects.where((F.col("type") == "r") & kind.isin("multipolygon", "boundary"))
    ways = relations.select("id", F.posexplode("members").alias("pos", "m")).where("m.type = 'w'").select("id", "pos", F.col("m.ref").alias("way"))
    return relations, ways


def _relation_areas(objects: DataFrame, located: DataFrame) -> DataFrame:
    """Multipolygon and boundary relations with their polygons; null where rings stay open or ways are missing."""
    relations, ways = _area_relations(objects)
    rows = ways.join(located.select(F.col("id").alias("way"), "refs"), "way", "left")
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "refs"))).alias("ways"))

    def build(batches):
        for batch in batches:
            areas = []
            for ways in batch.column(1).to_pylist():
                lines = [[(r["ref"], r["lon_e7"], r["lat_e7"]) for r in w["refs"] or ()] for w in ways]
                lost = any(w["refs"] is None for w in ways) or any(p[1] is None or p[2] is None for line in lines for p in line)
                made = None if lost else assemble(lines)
                areas.append(None if made is None else [[[{"lon_e7": x, "lat_e7": y} for x, y in ring] for ring in polygon] for polygon in made])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(areas, _AREA_ARROW)], names=["id", "built"])

    built = whole.mapInArrow(build, f"id bigint, built {_AREA}")
    return relations.join(built, "id", "left")


def _member_ways(objects: DataFrame) -> DataFrame:
    """The ways of relations that are areas, as a table of their own: the others need no locations."""
    members = _area_relations(objects)[1].select(F.col("way").alias("id")).distinct()
    ways = objects.where("type = 'w'").select("id", "version", "_src", "_seq", "refs")
    return materialise(ways.join(members, "id", "left_semi"), "member-ways")


def features(objects: DataFrame, config: ExportConfig = ExportConfig()) -> tuple[DataFrame, DataFrame]:
    """Features and errors.

    A feature has the object's columns, geometry_type, feature_id (letter and number; areas: twice the
    way's id, or twice the relation's and one), and points or an area. Errors are (type, id, reason): ways
    of fewer than two refs or without a location, areas that can't be built.
    """
    kinds = dict.fromkeys("polygon" if k == "multipolygon" else k for k in config.geometry_types)
    types = set(config.object_types)
    if kinds.keys() - {"point", "linestring", "polygon"} or types - set(TYPES):
        raise ValueError("Unknown type of geometry or object")
    locations = node_locations(objects)
    made, errors = [], []
    if "n" in types and "point" in kinds:
        nodes = objects.where((F.col("type") == "n") & F.col("lon_e7").isNotNull() & ((F.size("tags") > 0) | F.lit(config.keep_untagged)))
        made.append(_feature(nodes, F.lit("Point"), F.concat(F.lit("n"), "id"), F.array(F.struct("lon_e7", "lat_e7"))))
    if "w" in types:
        located = located_ways(objects.where("type = 'w'"), locations).select(*_COMMON)
        if "r" in types and "polygon" in kinds:  # ways' features and errors and relations' areas all begin with them
            located = materialise(located, "located-ways")
        found, wrong = _way_features(located, config, set(kinds))
        made, errors = [*made, found], [*errors, wrong]
    if "r" in types:
        if "w" not in types:
            located = located_ways(_member_ways(objects), locations)
        relations = _relation_areas(objects, located)
        if "polygon" in kinds:
            multi = _feature(relations.where("built is not null"), F.lit("MultiPolygon"), F.concat(F.lit("a"), F.col("id") * 2 + 1), area=F.col("built"))
            # The kind of a relation is no tag of its area.
            made.append(multi.withColumn("tags", F.filter("tags", lambda t: t["k"] != "type")))
        errors.append(relations.where("built is null").select("type", "id", F.lit("relation without closed rings").alias("reason")))
    none = objects.where(F.lit(False))
    out = _joined(made, _feature(none, F.lit(""), F.lit("")))
    return _with_output_tags(out, config), _joined(errors, none.select("type", "id", F.lit("").alias("reason")))


def _joined(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    out = parts[0] if parts else none
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _way_features(located: DataFrame, config: ExportConfig, kinds: set[str]) -> tuple[DataFrame, DataFrame]:
    """Lines and areas of ways, and errors. A way may be both: it is looked at once and comes with each kind that it is."""
    n = F.size("refs")
    lost = F.exists("refs", lambda r: r["lon_e7"].isNull() | r["lat_e7"].isNull())
    first, last = F.get("refs", F.lit(0)), F.get("refs", n - 1)
    same_end = (first["lon_e7"] == last["lon_e7"]) & (first["lat_e7"] == last["lat_e7"])
    line, area = line_and_area(config)
    ways = located.withColumns({"__lost": F.coalesce((n < 2) | lost, F.lit(True)), "__closed": same_end, "__line": line, "__area": area})
    untagged = (F.size("tags") == 0) & F.lit(config.keep_untagged)
    small = n < 4
    is_line = untagged | ~F.col("__closed") | F.col("__line")
    ringed = F.col("__closed") & F.col("__area")
    good = ~F.col("__lost")
    each = [F.when(good & is_line, "LineString")] if "linestring" in kinds else []
    each += [F.when(good & ringed & ~small, "MultiPolygon")] if "polygon" in kinds else []
    # No condition on what refs say: it would be moved below, and refs be put together once for each time that it names them.
    each = F.array_compact(F.array(*each)).cast("array<string>")
    good = ways.select(*_COMMON, each.alias("__each")).select(*_COMMON, F.explode_outer("__each").alias("__kind")).where("__kind is not null")
    is_area = F.col("__kind") == "MultiPolygon"
    ident = F.when(is_area, F.concat(F.lit("a"), F.col("id") * 2)).otherwise(F.concat(F.lit("w"), "id"))
    ring = counter_clockwise(_points(F.col("refs")))
    found = _feature(good, F.col("__kind"), ident, F.when(~is_area, _points(F.col("refs"))), F.when(is_area, F.array(F.array(ring))))
    reason = F.when(F.col("__lost"), "way without two located nodes").when(ringed & small, "area of fewer than four nodes")
    errors = ways.select("type", "id", reason.alias("reason")).where("reason is not null")
    return found, errors


def _with_output_tags(made: DataFrame, config: ExportConfig) -> DataFrame:
    names = list(config.attributes.values())
    keep = lambda t: F.lit(True)
    if config.include_tags:
        keep = lambda t: any_match(list(config.include_tags), t)
    elif config.exclude_tags:
        keep = lambda t: ~any_match(list(config.exclude_tags), t)
    shown = F.filter("tags", lambda t: keep(t) & (~t["k"].isin(*names) if names else F.lit(True)))
    out = made.withColumn("tags", shown)
    return out if config.keep_untagged else out.where(F.size("tags") > 0)


def wkt(least_digits: int = 0) -> Column:
    """Well-known text of a feature."""
    pairs = lambda c: point_list(c, "", " ", "", ",", least_digits)
    rings = lambda polygon: F.concat(F.lit("("), F.array_join(F.transform(polygon, lambda r: F.concat(F.lit("("), pairs(r), F.lit(")"))), ","), F.lit(")"))
    return (
        F.when(F.col("geometry_type") == "Point", F.concat(F.lit("POINT("), pairs(F.col("points")), F.lit(")")))
        .when(F.col("geometry_type") == "LineString", F.concat(F.lit("LINESTRING("), pairs(F.col("points")), F.lit(")")))
        .otherwise(F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform("area", rings), ","), F.lit(")")))
    )


def json_string(c: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x")))  # {"x":"..."}
    plain = c.rlike(r"^[ !#-\[\]-~]*\z")  # nothing to be escaped
    return F.when(plain, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def json_tags(tags: Column | str = "tags") -> Column:
    """Tags as the members of a JSON object, in their order; repeated keys stay."""
    return F.array_join(F.transform(tags, lambda t: F.concat(json_string(t["k"]), F.lit(":"), json_string(t["v"]))), ",")


def attribute_values(config: ExportConfig, iso: bool) -> list[tuple[str, str, Column]]:
    """(attribute, output name, text) of each attribute that is wanted, null where it has none."""
    names = F.lit(None)
    for letter, name in TYPE_NAMES.items():
        names = F.when(F.col("type") == letter, name).otherwise(names)
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'") if iso else F.coalesce(F.unix_timestamp("timestamp"), F.lit(0)).cast("string")
    refs = F.transform("refs", lambda r: r["ref"].cast("string"))
    text = {"type": names, "user": F.col("user"), "timestamp": time, "way_nodes": F.when((F.col("type") == "w") & (F.col("geometry_type") != "MultiPolygon"), F.array_join(refs, "/" if not iso else ","))}
    return [(a, config.attributes[a], text.get(a, F.col(a).cast("string"))) for a in ATTRIBUTES if a in config.attributes]


def _numbered_ids(made: DataFrame, config: ExportConfig) -> tuple[DataFrame, Column | None]:
    if config.unique_id == "counter":
        order = [F.col("geometry_type"), F.col("type"), F.col("id"), F.col("feature_id"), F.xxhash64("version", "tags")]
        return numbered(made, order, "counter"), F.col("counter").cast("string")
    return made, F.col("feature_id") if config.unique_id == "type_id" else None


def geojson_features(made: DataFrame, config: ExportConfig = ExportConfig()) -> DataFrame:
    """(json) a line for each feature."""
    made, ident = _numbered_ids(made, config)
    pairs = lambda c: point_list(c, "[", ",", "]", ",", 1)
    ringed = lambda r: F.concat(F.lit("["), pairs(r), F.lit("]"))
    polygon = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, ringed), ","), F.lit("]"))
    coordinates = (
        F.when(F.col("geometry_type") == "Point", pairs(F.col("points")))
        .when(F.col("geometry_type") == "LineString", F.concat(F.lit("["), pairs(F.col("points")), F.lit("]")))
        .otherwise(F.concat(F.lit("["), F.array_join(F.transform("area", polygon), ","), F.lit("]")))
    )
    head = F.lit('{"type":"Feature",')
    if ident is not None:
        head = F.concat(head, F.lit('"id":'), ident if config.unique_id == "counter" else json_string(ident), F.lit(","))
    numbers = {"id", "version", "changeset", "uid", "timestamp"}
    own = [F.concat(json_string(F.lit(n)), F.lit(":"), F.concat(F.lit("["), F.replace(v, F.lit("/"), F.lit(",")), F.lit("]")) if a == "way_nodes" else v if a in numbers else json_string(v)) for a, n, v in attribute_values(config, False)]
    tags = F.when(F.size("tags") > 0, json_tags())
    body = F.concat(head, F.lit('"geometry":{"type":"'), "geometry_type", F.lit('","coordinates":'), coordinates, F.lit('},"properties":{'), F.concat_ws(",", *own, tags), F.lit("}}"))
    return made.select(body.alias("json"))


def text_features(made: DataFrame, config: ExportConfig = ExportConfig()) -> DataFrame:
    """(line) well-known text, attributes and tags for each feature."""
    made, ident = _numbered_ids(made, config)
    own = [F.concat(F.lit(f"{n}="), v) for _, n, v in attribute_values(config, False)]
    tags = F.when(F.size("tags") > 0, F.array_join(F.transform("tags", lambda t: F.concat(t["k"], F.lit("="), t["v"])), ","))
    return made.select(F.concat(*([] if ident is None else [ident, F.lit(" ")]), wkt(), F.lit(" "), F.concat_ws(",", *own, tags)).alias("line"))


def pg_features(made: DataFrame, config: ExportConfig = ExportConfig()) -> DataFrame:
    """(line) for COPY into PostgreSQL: id, geometry as hexadecimal EWKB, attributes, tags as JSON or hstore."""
    made, ident = _numbered_ids(made, config)
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    own = []
    for a, _, v in attribute_values(config, True):
        own.append(F.coalesce(F.concat(F.lit("{"), v, F.lit("}")), F.lit("\\N")) if a == "way_nodes" else escape(v) if a == "user" else F.coalesce(v, F.lit("\\N")))
    if config.format_options.get("tags_type") == "hstore":
        quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        tags = F.array_join(F.transform("tags", lambda t: F.concat(quote(t["k"]), F.lit("=>"), quote(t["v"]))), ",")
    else:
        tags = F.concat(F.lit("{"), json_tags(), F.lit("}"))
    return with_ewkb(made).select(F.concat_ws("\t", *([] if ident is None else [ident]), "ewkb", *own, escape(tags)).alias("line"))


def with_ewkb(made: DataFrame) -> DataFrame:
    """Features with their geometry as hexadecimal EWKB in longitude and latitude."""

    @F.arrow_udf("string")
    def encode(kind: pa.Array, points: pa.Array, area: pa.Array) -> pa.Array:
        return ewkb_column(kind, points, area)

    return made.withColumn("ewkb", encode("geometry_type", "points", "area"))

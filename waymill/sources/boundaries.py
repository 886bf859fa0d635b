"""Regions from GeoJSON, polygon files, map objects and extract configurations; read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.functions.geometry import Point, Region, assemble
from waymill.operators.extracting import MAX_EXTRACTS


class BoundaryError(ValueError):
    """A boundary that can't be read."""


def _e7(value) -> int:
    return round(float(value) * 1e7)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, by Spark's readers."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def _rings(polygon) -> list[list[Point]]:
    if not isinstance(polygon, list) or not polygon:
        raise BoundaryError("A polygon is a list of rings")
    out = []
    for ring in polygon:
        points = [(_e7(p[0]), _e7(p[1])) for p in ring]
        if len(points) < 4 or points[0] != points[-1]:
            raise BoundaryError("A ring has four points or more, the last like the first")
        out.append(points)
    return out


def of_geojson(text: str) -> Region:
    """A Polygon or MultiPolygon, bare, in a Feature, or in the first Feature of a collection."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise BoundaryError(f"No JSON: {e}") from e
    if not isinstance(found, dict):
        raise BoundaryError("The top of a GeoJSON file is an object")
    if found.get("type") == "FeatureCollection":
        if not found.get("features"):
            raise BoundaryError("A collection without features")
        found = found["features"][0]
    if found.get("type") == "Feature":
        found = found.get("geometry") or {}
    if found.get("type") == "Polygon":
        return Region.of_polygons([_rings(found.get("coordinates"))])
    if found.get("type") == "MultiPolygon":
        return Region.of_polygons([_rings(p) for p in found.get("coordinates") or []])
    raise BoundaryError("A boundary is a Polygon or MultiPolygon")


def of_poly(text: str) -> Region:
    """A title, then rings: a name (! for a hole), lines of longitude and latitude, END; one more END. Rings close themselves."""
    lines = [line.strip() for line in text.splitlines()]
    lines = lines[1:]
    polygons: list[list[list[Point]]] = []
    ring: list[Point] | None = None
    hole = ended = False
    for line in lines:
        if not line:
            continue
        if line == "END":
            if ring is None:
                ended = True
                break
            if len(ring) < 3:
                raise BoundaryError("A ring has three points or more")
            if hole:
                if not polygons:
                    raise BoundaryError("A hole before any outer ring")
                polygons[-1].append(ring)
            else:
                polygons.append([ring])
            ring = None
        elif ring is None:
            ring, hole = [], line.startswith("!")
        else:
            try:
                lon, lat = line.split()[:2]
                ring.append((_e7(lon), _e7(lat)))
            except ValueError as e:
                raise BoundaryError(f"Not a point: {line!r}") from e
    if not ended or not polygons:
        raise BoundaryError("Rings and the file end with END")
    return Region.of_polygons(polygons)


def of_objects(objects: DataFrame) -> Region:
    """The polygons of all multipolygon and boundary relations of a file, and of its closed ways if there is no such relation.

    Only the boundary comes to the driver: those relations, their ways, and the nodes of these.
    """
    kind = F.get(F.filter("tags", lambda t: t["k"] == "type"), F.lit(0))["v"]
    relations = objects.where((F.col("type") == "r") & kind.isin("multipolygon", "boundary")).select(F.expr("transform(filter(members, m -> m.type = 'w'), m -> m.ref)").alias("ways"))
    groups = [r.ways for r in relations.collect()]
    own = objects.where("type = 'w'").select("id", F.col("refs.ref").alias("refs"))
    if groups:
        own = own.join(relations.select(F.explode("ways").alias("id")).distinct(), "id", "left_semi")
    else:
        own = own.where("size(refs) > 3 and refs[0] = refs[size(refs) - 1]")
    nodes = objects.where("type = 'n'").select("id", "lon_e7", "lat_e7").join(own.select(F.explode("refs").alias("id")).distinct(), "id", "left_semi")
    places = {r.id: (r.lon_e7, r.lat_e7) for r in nodes.collect()}
    ways = {r.id: [(n, *places[n]) for n in r.refs if n in places] for r in own.collect()}
    polygons = [p for g in groups or [[w] for w in ways] for p in assemble([ways[w] for w in g if w in ways]) or []]
    if not polygons:
        raise BoundaryError("No polygon in the file")
    return Region.of_polygons(polygons)


def of_box(text: str) -> Region:
    """LEFT,BOTTOM,RIGHT,TOP."""
    try:
        a, b, c, d = (_e7(x) for x in text.split(","))
    except ValueError as e:
        raise BoundaryError("A box is LEFT,BOTTOM,RIGHT,TOP") from e
    if a > c or b > d:
        raise BoundaryError("LEFT and BOTTOM come before RIGHT and TOP")
    if max(abs(a), abs(c)) > 1_800_000_000 or max(abs(b), abs(d)) > 900_000_000:
        raise BoundaryError("Longitudes go to 180 degrees, latitudes to 90")
    return Region((a, b, c, d))


@dataclass(frozen=True)
class ExtractPlan:
    """One extract of a configuration."""

    output: str
    region: Region
    output_format: str | None = None
    description: str = ""
    header: dict | None = None


def read_extract_config(spark: SparkSession, path: str) -> list[ExtractPlan]:
    """The extracts of a configuration file: each with an output and a bbox, polygon or multipolygon, written out or by file name."""
    config = json.loads(read_text(spark, path))
    folder, base = config.get("directory", ""), path.rpartition("/")[0]
    if not config.get("extracts"):
        raise BoundaryError("A configuration without extracts")
    if len(config["extracts"]) > MAX_EXTRACTS:
        raise BoundaryError(f"{MAX_EXTRACTS} extracts at most")
    out = []
    for e in config["extracts"]:
        if "output" not in e:
            raise BoundaryError("An extract without an output")
        kinds = [k for k in ("bbox", "polygon", "multipolygon") if k in e]
        if len(kinds) != 1:
            raise BoundaryError("An extract has one of bbox, polygon and multipolygon")
        value = e[kinds[0]]
        if kinds[0] == "bbox":
            if isinstance(value, dict):
                value = [value[k] for k in ("left", "bottom", "right", "top")]
            region = Region.of_box((_e7(value[0]), _e7(value[1])), (_e7(value[2]), _e7(value[3])))
        elif isinstance(value, dict):
            name = value["file_name"] if value["file_name"].startswith("/") else f"{base}/{value['file_name']}"
            region = read_boundary(spark, name, value.get("file_type"))
        else:
            region = Region.of_polygons([_rings(value)] if kinds[0] == "polygon" else [_rings(p) for p in value])
        out.append(ExtractPlan(f"{folder}/{e['output']}" if folder else e["output"], region, e.get("output_format"), e.get("description", ""), e.get("output_header")))
    return out


def read_boundary(spark: SparkSession, path: str, kind: str | None = None) -> Region:
    """By suffix: .json and .geojson, .poly, else a file of map objects."""
    kind = kind or ("geojson" if path.endswith(("json", "geojson")) else "poly" if path.endswith("poly") else "osm")
    if kind in ("geojson", "poly"):
        return (of_geojson if kind == "geojson" else of_poly)(read_text(spark, path))
    from waymill.sources.files import read

    return of_objects(read(spark, [path]).df)

"""Geographic extracts: objects inside regions, and what belongs to them by one of four strategies."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.functions.geometry import contains_points, Region
from waymill.functions.tags import tag_filter
from waymill.model import tag_value
from waymill.scratch import materialise

#: Extracts of one run, at most.
MAX_EXTRACTS = 500
#: Cells of the grid over all regions of a run, at most (four for each region, if these are more).
GRID_CELLS = 100_000
KEYED = ["extract", "id"]


def region_cells(regions: Mapping[str, Region], most: int = GRID_CELLS) -> tuple[int, list[tuple]]:
    """(bits, rows) of a grid over all regions: cells of 2^bits on a side, as small as ``most`` cells in all allow.

    A row for each region and cell that it may hold points of: cx, cy, extract, whole (all of the cell is
    inside), polygon (only the rings can tell), and the region's box.
    """
    boxes = {name: r.box for name, r in regions.items()}
    bits = 18
    while bits < 29 and sum(((c >> bits) - (a >> bits) + 1) * ((d >> bits) - (b >> bits) + 1) for a, b, c, d in boxes.values()) > most:
        bits += 1
    rows = []
    for name, region in regions.items():
        a, b, c, d = region.box
        left, low = a >> bits, b >> bits
        wide, high = (c >> bits) - left + 1, (d >> bits) - low + 1
        cx, cy = (x.ravel() for x in np.meshgrid(np.arange(left, left + wide), np.arange(low, low + high), indexing="ij"))
        size = 1 << bits
        whole = (cx * size >= a) & ((cx + 1) * size - 1 <= c) & (cy * size >= b) & ((cy + 1) * size - 1 <= d)
        edges = region.edges()
        if edges:
            touched = touched_cells(edges, bits, left, low, wide, high).ravel()
            corner = contains_points(edges, cx * size, cy * size)
            use = touched | corner
            cx, cy, whole, touched = cx[use], cy[use], whole[use] & ~touched[use], touched[use]
        else:
            touched = np.zeros(len(cx), dtype=bool)
        rows += [(int(x), int(y), name, bool(w), bool(t), *region.box) for x, y, w, t in zip(cx, cy, whole, touched, strict=True)]
    return bits, rows


def touched_cells(edges: list[tuple[int, int, int, int]], bits: int, left: int, low: int, wide: int, high: int) -> np.ndarray:
    """Cells (by column, row) that some edge may pass, with a margin of one unit."""
    out = np.zeros((wide, high), dtype=bool)
    size = 1 << bits
    for x1, y1, x2, y2 in edges:
        if y1 > y2:
            x1, y1, x2, y2 = x2, y2, x1, y1
        rows = np.arange((y1 - 1) >> bits, ((y2 + 1) >> bits) + 1)
        if y1 == y2:
            near, far = np.full(len(rows), float(min(x1, x2))), np.full(len(rows), float(max(x1, x2)))
        else:
            bounds = np.clip(np.array([rows * size - 1, (rows + 1) * size]), y1, y2)
            xs = x1 + (bounds - y1) * ((x2 - x1) / (y2 - y1))
            near, far = xs.min(axis=0), xs.max(axis=0)
        for row, a, b in zip(rows.tolist(), near.tolist(), far.tolist(), strict=True):
            if 0 <= row - low < high:
                out[max(0, (int(a) - 2 >> bits) - left) : max(0, (int(b) + 2 >> bits) - left + 1), row - low] = True
    return out


def _inside(nodes: DataFrame, regions: Mapping[str, Region]) -> DataFrame:
    """(extract, id) of the nodes in each region: nodes meet regions by cells of a grid, and only in cells that an edge passes the rings are asked."""
    lon, lat = F.col("lon_e7"), F.col("lat_e7")
    boxes = [r.box for r in regions.values()]
    all_box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
    near = nodes.where(lon.between(all_box[0], all_box[2]) & lat.between(all_box[1], all_box[3]))  # reaches the scan
    bits, rows = region_cells(regions)
    cells = nodes.sparkSession.createDataFrame(rows, "cx int, cy int, extract string, whole boolean, polygon boolean, a int, b int, c int, d int")
    near = near.withColumns({"cx": F.shiftright(lon, bits), "cy": F.shiftright(lat, bits)})
    met = near.join(F.broadcast(cells), ["cx", "cy"])  # GRID_CELLS rows, or four for each region
    met = met.where(F.col("whole") | (lon.between(F.col("a"), F.col("c")) & lat.between(F.col("b"), F.col("d"))))
    polygons = {name: r.edges() for name, r in regions.items() if r.polygons}
    if not polygons:
        return met.select(*KEYED).distinct()
    met = materialise(met.select("id", "extract", "polygon", "lon_e7", "lat_e7"), "extract-met")
    shared = nodes.sparkSession.sparkContext.broadcast(polygons)  # the boundaries, which came from the driver

    def test(batches):
        for batch in batches:
            names = np.asarray(batch.column(1).to_pylist(), dtype=object)
            x, y = (np.asarray(batch.column(k), dtype=np.int64) for k in (2, 3))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for name in set(names.tolist()):
                at = np.flatnonzero(names == name)
                keep[at] = contains_points(shared.value[name], x[at], y[at])
            yield batch.select([1, 0]).filter(pa.array(keep))

    asked = met.where("polygon").select("id", "extract", "lon_e7", "lat_e7").mapInArrow(test, "extract string, id long")
    return met.where("not polygon").select(*KEYED).union(asked).distinct()


class _Graph:
    """References of the objects, by way and by relation."""

    def __init__(self, objects: DataFrame):
        self.objects = objects
        self.node_refs = objects.where("type = 'w'").select("id", F.explode("refs.ref").alias("ref"))
        members = objects.where("type = 'r'").select("id", F.explode("members").alias("m"))
        self.members = members.select("id", F.col("m.type").alias("type"), F.col("m.ref").alias("ref"))

    def ways_with(self, nodes: DataFrame) -> DataFrame:
        """Ways with any of the nodes."""
        return self.node_refs.join(nodes.withColumnRenamed("id", "ref"), "ref").select(*KEYED).distinct()

    def nodes_of(self, ways: DataFrame) -> DataFrame:
        return self.node_refs.join(ways, "id").select("extract", F.col("ref").alias("id")).distinct()

    def relations_with(self, nodes: DataFrame, ways: DataFrame) -> DataFrame:
        """Relations with any of the nodes or ways as a member."""
        sets = nodes.select("extract", F.lit("n").alias("type"), F.col("id").alias("ref")).union(ways.select("extract", F.lit("w"), "id"))
        return self.members.join(sets, ["type", "ref"]).select(*KEYED).distinct()

    def members_of(self, relations: DataFrame, kind: str) -> DataFrame:
        return self.members.where(F.col("type") == kind).join(relations, "id").select("extract", F.col("ref").alias("id")).distinct()

    def with_ancestors(self, relations: DataFrame) -> DataFrame:
        """Relations and all that hold them at any depth; each level's new ones are written out."""
        edges = materialise(self.members.where("type = 'r'").select(F.col("ref").alias("child"), F.col("id").alias("parent")).distinct(), "extract-edges")
        frontier = materialise(relations, "extract-level")
        found = frontier
        while not frontier.isEmpty():
            up = frontier.join(edges, F.col("id") == F.col("child")).select("extract", F.col("parent").alias("id")).distinct()
            frontier = materialise(up.join(found, KEYED, "left_anti"), "extract-level")
            found = found.unionByName(frontier)
        return found


def _completed(graph: _Graph, nodes: DataFrame, ways: DataFrame, types: list[str] | None, percent: int, tags: list[str]) -> DataFrame:
    """Relations with a member in the extract that are to be complete: of a wanted type, or with enough members there, and with fitting tags."""
    sets = nodes.select("extract", F.lit("n").alias("type"), F.col("id").alias("ref")).union(ways.select("extract", F.lit("w"), "id"))
    wanted = graph.members.join(sets, ["type", "ref"]).groupBy(*KEYED).agg(F.count("*").alias("wanted"))
    relations = graph.objects.where("type = 'r'")
    kind: Column = F.lit(True) if not types or "any" in types else F.coalesce(tag_value("type").isin(*types), F.lit(False))
    fits = F.lit(True)
    if tags:
        fits = reduce(lambda a, b: a | b, [tag_filter(t).matcher.any_of() for t in tags])
    judged = relations.select("id", F.size("members").alias("n"), kind.alias("kind"), fits.alias("fits")).join(wanted, "id")
    enough = F.col("wanted") * 100 >= F.col("n") * percent if percent < 100 else F.col("wanted") >= F.col("n")
    return judged.where((F.col("kind") | enough) & F.col("fits")).select(*KEYED).distinct()


def extract_ids(
    objects: DataFrame,
    regions: Mapping[str, Region],
    strategy: str = "complete_ways",
    relations: bool = True,
    types: list[str] | None = None,
    complete_percent: int = 100,
    complete_tags: list[str] | None = None,
) -> DataFrame:
    """(extract, type, id) of what belongs to each region, for all regions at once.

    simple: nodes inside, ways with such a node, relations with such a node or way.
    complete_ways: also all nodes of those ways, and all relations above (none with relations=False).
    smart: also the ways and nodes of relations that are to be complete: those of ``types`` (default
    multipolygon; "any": all), or with complete_percent of their members inside, whose tags fit complete_tags.
    Members are judged by the nodes and ways inside, not by what is added.
    """
    if strategy not in ("simple", "complete_ways", "smart"):
        raise ValueError(f"Unknown strategy {strategy!r}")
    if not 0 < len(regions) <= MAX_EXTRACTS:
        raise ValueError(f"One to {MAX_EXTRACTS} extracts in a run")
    graph = _Graph(objects)
    inside = objects.where("type = 'n' and lon_e7 is not null and lat_e7 is not null").select("id", "lon_e7", "lat_e7")
    nodes = materialise(_inside(inside, regions), "extract-nodes")
    ways = materialise(graph.ways_with(nodes), "extract-ways")
    found = graph.relations_with(nodes, ways)
    if strategy == "simple":
        return _typed(nodes, ways, found)
    if strategy == "complete_ways" and not relations:
        return _typed(nodes.union(graph.nodes_of(ways)).distinct(), ways, None)
    all_nodes, all_ways = nodes, ways
    if strategy == "smart":
        complete = materialise(_completed(graph, nodes, ways, ["multipolygon"] if types is None else types, complete_percent, complete_tags or []), "extract-complete")
        all_ways = materialise(ways.union(graph.members_of(complete, "w")).distinct(), "extract-all-ways")
        all_nodes = nodes.union(graph.members_of(complete, "n"))
    return _typed(all_nodes.union(graph.nodes_of(all_ways)).distinct(), all_ways, graph.with_ancestors(found))


def _typed(nodes: DataFrame, ways: DataFrame, relations: DataFrame | None) -> DataFrame:
    parts = [df.select("extract", F.lit(t).alias("type"), "id") for t, df in (("n", nodes), ("w", ways), ("r", relations)) if df is not None]
    return reduce(DataFrame.union, parts)


def extract(objects: DataFrame, regions: Mapping[str, Region], strategy: str = "complete_ways", history: bool = False, **options) -> DataFrame:
    """The objects of each extract (column extract first); objects are never clipped.

    history: the input holds many versions; sets are by id over all of them. Only complete_ways takes that.
    """
    if history and strategy != "complete_ways":
        raise ValueError(f"Strategy {strategy} doesn't take history")
    ids = extract_ids(objects, regions, strategy, **options)
    return objects.join(ids, ["type", "id"]).select("extract", *objects.columns)


def write_extracts(extracted: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each extract."""
    extracted.write.mode(mode).partitionBy("extract").parquet(path)

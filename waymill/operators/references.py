"""Which objects refer to which: edges, transitive closure, completion, and checks for missing ones.

An id set is a DataFrame (type, id) without repeats. Ids in sets are absolute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill.model import canonical_order
from waymill.scratch import materialise

KEY = ["type", "id"]


def id_set(df: DataFrame) -> DataFrame:
    """The (type, absolute id) of all rows."""
    return df.select("type", F.abs("id").alias("id")).distinct()


def node_refs(objects: DataFrame) -> DataFrame:
    """(id of the way, ref) for each node reference of the ways, repeats included."""
    return objects.where("type = 'w'").select("id", F.explode("refs.ref").alias("ref"))


def member_refs(objects: DataFrame) -> DataFrame:
    """(id of the relation, type, ref) for each member, repeats included."""
    return objects.where("type = 'r'").select("id", F.explode("members").alias("m")).select("id", F.col("m.type").alias("type"), F.col("m.ref").alias("ref"))


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All ids that can be reached from the seeds (column id) along edges (src, dst), seeds included.

    One round for each level of nesting; only newly found ids go on, so cycles end. Each
    round's ids are written out, and the driver sees but whether there are any.
    """
    edges = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "closure-edges")
    frontier = materialise(seeds.select("id").distinct(), "closure-level")
    found = frontier
    while not frontier.isEmpty():
        reached = edges.join(frontier, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = materialise(reached.join(found, "id", "left_anti"), "closure-level")
        found = found.unionByName(frontier)
    return found


def relation_edges(objects: DataFrame) -> DataFrame:
    """(src, dst): a relation and a relation that is a member of it."""
    return member_refs(objects).where("type = 'r'").select(F.col("id").alias("src"), F.col("ref").alias("dst"))


def referenced(objects: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids of all that the seeds (type, id) need: members of relations at any depth, then nodes of ways.

    The seeds themselves are not included unless something refers to them.
    """
    relations = seeds.where("type = 'r'").select("id")
    edges = relation_edges(objects)
    deep = materialise(closure(relations, edges), "referenced-relations")
    members = member_refs(objects).join(deep, "id", "left_semi").select("type", F.col("ref").alias("id")).distinct()
    members = materialise(members, "referenced-members")
    ways = members.where("type = 'w'").select("id").union(seeds.where("type = 'w'").select("id")).distinct()
    nodes = node_refs(objects).join(ways, "id", "left_semi").select(F.lit("n").alias("type"), F.col("ref").alias("id"))
    return members.union(nodes).distinct()


def first_occurrences(df: DataFrame) -> DataFrame:
    """Of each (type, id) the row that comes first in the input."""
    first = Window.partitionBy(*KEY).orderBy("_src", "_seq")
    return df.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def with_absolute(objects: DataFrame) -> DataFrame:
    return objects.withColumn("__abs", F.abs("id"))


def in_set(objects: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose (type, absolute id) is in the set (left_semi) or isn't (left_anti)."""
    o, s = with_absolute(objects).alias("o"), ids.alias("s")
    return o.join(s, (F.col("o.type") == F.col("s.type")) & (F.col("o.__abs") == F.col("s.id")), how).drop("__abs")


def get_ids(objects: DataFrame, ids: DataFrame, add_referenced: bool = False, history: bool = False, remove_tags: bool = False) -> DataFrame:
    """Objects of an id set; with add_referenced also all that these need.

    Every row of an asked-for id is given. Of ids that are only referred to the first row
    is (all with history); remove_tags empties these rows' tags.
    """
    asked = materialise(ids.select(*KEY).distinct(), "asked-ids")
    direct = in_set(objects, asked)
    if not add_referenced:
        return direct
    extra = referenced(objects, asked).join(asked, KEY, "left_anti")
    pulled = in_set(objects, extra)
    if not history:
        pulled = first_occurrences(pulled)
    if remove_tags:
        pulled = pulled.withColumn("tags", F.slice("tags", 1, 0))
    return direct.unionByName(pulled)


def missing_ids(objects: DataFrame, ids: DataFrame, add_referenced: bool = False) -> DataFrame:
    """Ids of the set (and, if wanted, of what it needs) that no object has."""
    wanted = ids.select(*KEY).distinct()
    if add_referenced:
        wanted = wanted.union(referenced(objects, wanted)).distinct()
    return wanted.join(id_set(objects), KEY, "left_anti")


def remove_ids(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """Objects that are not in the id set."""
    return in_set(objects, ids.select(*KEY).distinct(), "left_anti")


def get_parents(objects: DataFrame, ids: DataFrame, add_self: bool = False) -> DataFrame:
    """Ways with a listed node and relations with a listed member, one level up; add_self: the listed objects too."""
    ids = materialise(ids.select(*KEY).distinct(), "child-ids")
    refs = node_refs(objects).select("id", F.lit("n").alias("type"), F.abs("ref").alias("ref"), F.lit("w").alias("parent"))
    refs = refs.union(member_refs(objects).select("id", "type", F.abs("ref"), F.lit("r")))
    child = ids.select("type", F.col("id").alias("ref"))
    parents = refs.join(child, ["type", "ref"], "left_semi").select(F.col("parent").alias("type"), F.abs("id").alias("id"))
    wanted = (parents.union(ids) if add_self else parents).distinct()
    return in_set(objects, wanted)


def check_refs(objects: DataFrame, relations: bool = False) -> DataFrame:
    """One row of counts: objects by type, and what is referred to but missing.

    Nodes missing from ways count each time they are referred to. With relations: nodes and
    ways missing from relations count once for each id, relations each time.
    """
    code = lambda kind: F.when(kind == "n", 0).when(kind == "w", 1).when(kind == "r", 2)
    entry = lambda kind, ref, own, way, relation: [code(kind).alias("kind"), ref.alias("ref"), *[F.lit(n).cast("bigint").alias(c) for c, n in (("own", own), ("way", way), ("relation", relation))]]
    rows = objects.select(*entry(F.col("type"), F.col("id"), 1, 0, 0))
    rows = rows.union(node_refs(objects).select(*entry(F.lit("n"), F.col("ref"), 0, 1, 0)))
    if relations:
        rows = rows.union(member_refs(objects).select(*entry(F.col("type"), F.col("ref"), 0, 0, 1)))
    # One row for each id: what is there, and how often ways and relations refer to it.
    ids = rows.groupBy("kind", "ref").agg(*[F.sum(c).alias(c) for c in ("own", "way", "relation")])
    lost = (F.col("own") == 0) | F.col("ref").isNull()
    total = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    counts = [total(n, F.col("own")).alias(name) for n, name in enumerate(("nodes", "ways", "relations"))]
    counts.append(total(0, F.when(lost, F.col("way"))).alias("missing_nodes_in_ways"))
    if relations:
        once = F.when(lost & (F.col("relation") > 0) & F.col("ref").isNotNull(), F.lit(1).cast("bigint"))
        counts += [total(0, once).alias("missing_nodes_in_relations"), total(1, once).alias("missing_ways_in_relations"), total(2, F.when(lost, F.col("relation"))).alias("missing_relations_in_relations")]
    return ids.agg(*counts)


def missing_refs(objects: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """(type, ref, parent_type, parent_id) of each reference to an object that isn't there."""
    have = objects.select(*KEY).distinct() if have is None else have
    refs = node_refs(objects).select(F.lit("n").alias("type"), "ref", F.lit("w").alias("parent_type"), F.col("id").alias("parent_id"))
    refs = refs.union(member_refs(objects).select("type", "ref", F.lit("r"), "id"))
    return refs.join(have.select("type", F.col("id").alias("ref")), ["type", "ref"], "left_anti").select("type", "ref", "parent_type", "parent_id")


def missing_ref_lines(objects: DataFrame) -> DataFrame:
    """The report of missing references: for ways and for relation members of relations each,
    for nodes and ways in relations the first referrer in the order of the input."""
    lost = missing_refs(objects)
    every = lost.where("parent_type = 'w' or type = 'r'").distinct()
    place = objects.where("type = 'r'").groupBy("id").agg(F.min(F.struct("_src", "_seq")).alias("place"))
    rest = lost.where("parent_type = 'r' and type <> 'r'").join(place, F.col("parent_id") == F.col("id"))
    firsts = rest.groupBy("type", "ref", "parent_type").agg(F.min_by("parent_id", "place").alias("parent_id"))
    lines = every.unionByName(firsts.select(*every.columns))
    return lines.withColumn("line", F.concat("type", "ref", F.lit(" in "), "parent_type", "parent_id"))


def in_canonical_order(objects: DataFrame) -> DataFrame:
    return objects.orderBy(*canonical_order())

"""Queries beside the same in SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
#: The rest is run by the driver; these stand for each kind of operator.
CHOSEN = (
    "cat_union", "tags_filter_negated", "tags_filter_area", "tags_filter_complete", "getid_referenced", "getid_missing", "getparents_self", "changeset_filter_time", "time_filter_range", "check_refs_relations",
    "fileinfo_facts", "tags_count_tags", "sort_canonical", "merge", "merge_changes_simplify", "apply_changes", "apply_changes_redact", "derive_changes", "diff_status", "renumber_refs",
    "add_locations", "locations_index_update", "extract_bbox_smart", "extract_polygon", "export_lines", "export_areas_closed_ways", "export_geojson",
    "sort_simple", "fileinfo_order_facts", "merge_order_errors", "tags_count_sorted_name_desc", "replication_stream", "renumber_index", "extract_smart_percent", "extract_history", "extract_many_edges", "extract_many_regions",
    "export_relation_areas", "export_all_errors", "export_copy_lines", "export_counter_ids", "export_rules_list_and_other", "files_osm_bz2", "files_osm_pbf", "header_box",
)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return connection


def plain(rows):
    return sorted(repr([float(f"{v:.9g}") if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_as_sql(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = tables.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert plain([[r[c] for c in columns] for r in df.collect()]) == plain([[r[p] for p in places] for r in found.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())

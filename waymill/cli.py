"""Command line: ``python -m waymill COMMAND ...``. Exit codes: 0 well, 1 a failure or a negative result, 2 bad arguments."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import shlex
import shutil
import subprocess
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.functions.tags import read_expressions
from waymill.model import Dataset, canonical_order
from waymill.operators import changes, exporting, extracting, filters, locations, merging, references, renumbering, summary
from waymill.sources import boundaries, debug, files, ids, opl, xmlfile
from waymill.sources.boundaries import read_text


class UsageError(ValueError):
    """Arguments that can't be meant."""


def session() -> SparkSession:
    """The session that runs, or one for this machine."""
    return SparkSession.getActiveSession() or (SparkSession.builder.appName("waymill").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())


def time_of(text: str) -> datetime:
    try:
        return datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    except ValueError as e:
        raise UsageError("Times are written yyyy-mm-ddThh:mm:ssZ") from e


def _read(args, paths: list[str]) -> Dataset:
    return files.read(session(), paths, args.input_format)


def _each(args, paths: list[str]) -> list[DataFrame]:
    return [_read(args, [p]).df for p in paths]


def _types(args, df: DataFrame) -> DataFrame:
    letters = [t[0] for t in args.object_type or ()]
    if set(letters) - set("nwr"):
        raise UsageError("Object types are node, way and relation")
    return filters.of_types(df, "".join(letters)) if letters else df


def _write(args, dataset: Dataset) -> None:
    _save(args, dataset, args.output, args.output_format)


def _save(args, dataset: Dataset, path: str, form: str | None) -> None:
    """A folder of part files, or with --join one local file."""
    if not args.join:
        return files.write(dataset, path, form, args.overwrite, args.output_header)
    if os.path.exists(path) and not args.overwrite:
        raise ValueError(f"{path} is there already")
    form, parts = form or files.suffix(path), f"{path}.parts"
    encoding = files.resolve(path, form).encoding
    if encoding == "parquet":
        raise UsageError("Parquet is always a folder")
    files.write(dataset, parts, form, True, args.output_header)
    files.join_parts(parts, path)
    shutil.rmtree(parts)


def _print(df: DataFrame) -> None:
    """Rows of one text column, a partition at a time."""
    for row in df.toLocalIterator():
        print(row[0])


def _ids(args) -> DataFrame:
    spark, default = session(), (args.default_type or "node")[0]
    found = ids.ids_of_arguments(spark, args.ids, default)
    for path in args.id_file or ():
        found = found.union(ids.read_ids(spark, path, default))
    for path in args.id_osm_file or ():
        found = found.union(ids.ids_of_objects(_read(args, [path]).df))
    return found.distinct()


def _expressions(args) -> list[str]:
    found = list(args.expression)
    if args.expressions:
        found += read_expressions(read_text(session(), args.expressions).splitlines())
    return found


def add_locations_to_ways(args):
    d = _read(args, args.input)
    df = locations.add_locations(d.df, args.keep_untagged_nodes, args.keep_member_nodes, args.ignore_missing_nodes)
    args.output_format = f"{args.output_format or files.suffix(args.output)},locations_on_ways=true"
    _write(args, Dataset(references.in_canonical_order(df), d.header, d.kind))


def apply_changes(args):
    d = _read(args, [args.input])
    if args.locations_on_ways and (args.with_history or args.redact or d.kind == "history"):
        raise UsageError("Locations on ways can't go with history")
    made = files.resolve(args.output, args.output_format).kind
    history = args.with_history or args.redact or d.kind == "history"
    if not (args.with_history or args.redact) and (d.kind == "history") != (made == "history"):
        raise UsageError("Data and history can't be mixed without --with-history")
    given = _each(args, args.changes)
    if history:
        args.output_format = f"{args.output_format or files.suffix(args.output)},history=true"
        df = changes.apply_changes_history(d.df, given, args.redact)
    elif args.locations_on_ways:
        df = changes.apply_changes_locations(d.df, given)
    else:
        df = changes.apply_changes(d.df, given)
    _write(args, Dataset(references.in_canonical_order(df), d.header, "history" if history else d.kind))


def cat(args):
    d = _read(args, args.input)
    _write(args, Dataset(merging.clean(_types(args, d.df), args.clean or []).orderBy("_src", "_seq"), d.header, d.kind))


def changeset_filter(args):
    some = lambda yes, no: True if yes else False if no else None
    box = boundaries.of_box(args.bbox).box if args.bbox else None
    rows = xmlfile.read_changesets(session(), args.input)
    conditions = {"with_discussion": some(args.with_discussion, args.without_discussion), "with_changes": some(args.with_changes, args.without_changes), "open_": some(args.open, args.closed), "uid": args.uid, "user": args.user}
    found = filters.changeset_filter(rows, **conditions, after=args.after and time_of(args.after), before=args.before and time_of(args.before), bbox=box)
    opl.changeset_lines(found.orderBy("id")).write.mode("overwrite" if args.overwrite else "errorifexists").text(args.output)


def check_refs(args):
    df = _read(args, [args.input]).df
    counts = references.check_refs(df, args.check_relations).first().asDict()
    print("\n".join(f"{k}: {v}" for k, v in counts.items()))
    if args.show_ids:
        lines = references.missing_ref_lines(df)
        _print((lines if args.check_relations else lines.where("parent_type = 'w'")).select("line"))
    return int(any(v for k, v in counts.items() if k.startswith("missing")))


def create_locations_index(args):
    before = locations.read_index(session(), args.index_file) if args.update else None
    index = locations.locations_index(_read(args, [args.input]).df, before)
    if before is not None:
        from waymill.scratch import materialise

        index = materialise(index, "index")  # the folder that is read is written anew
    locations.write_index(index, args.index_file, "overwrite" if args.update or args.overwrite else "errorifexists")


def derive_changes(args):
    old, new = (_read(args, [p]) for p in args.input)
    stamp = F.current_timestamp() if args.update_timestamp else None
    df = changes.derive_changes(old.df, new.df, args.increment_version, args.keep_details, stamp)
    _write(args, Dataset(references.in_canonical_order(df), new.header, "change"))


def diff(args):
    a, b = (_types(args, _read(args, [p]).df) for p in args.input)
    ignored = tuple(k for k in ("changeset", "uid", "user") if getattr(args, f"ignore_{k}"))
    whole = args.output_format in ("opl", "debug")
    found = changes.diff(a, b, ignored, keep_rows=whole)
    order = canonical_order(src=False)[:4]
    shown = found.where("status <> ' '") if args.suppress_common else found
    if args.quiet:
        return int(not changes.identical(found))
    if whole:
        text = (lambda df: opl.lines(df)) if args.output_format == "opl" else debug.blocks
        for mark, side, kinds in (("-", "old", ("-", "*")), ("+", "new", ("+", "*")), (" ", "new", (" ",))):
            rows = shown.where(F.col("status").isin(*kinds)).select(f"{side}.*").orderBy(*canonical_order())
            for row in text(rows).toLocalIterator():
                print("\n".join(mark + line for line in row[0].split("\n")))
    else:
        _print(changes.diff_lines(shown.orderBy(*[o for o in order])).select("line"))
    if args.summary:
        print(" ".join(f"{k}={v}" for k, v in changes.diff_summary(found).first().asDict().items()), file=sys.stderr)
    return int(not changes.identical(found))


def export(args):
    text = read_text(session(), args.config) if args.config else ""
    wanted = tuple(args.geometry_types.split(",")) if args.geometry_types else ("point", "linestring", "polygon")
    config = exporting.read_config(text, keep_untagged=args.keep_untagged, geometry_types=wanted, unique_id=args.add_unique_id)
    made, errors = exporting.features(_read(args, [args.input]).df, config)
    if (args.show_errors or args.stop_on_error) and not errors.isEmpty():
        for row in errors.toLocalIterator():
            print(f"{row.type}{row.id}: {row.reason}", file=sys.stderr)
        if args.stop_on_error:
            return 1
    kind = args.output_format or {"geojson": "geojson", "json": "geojson", "geojsonseq": "geojsonseq", "jsonseq": "geojsonseq", "pg": "pg", "text": "text", "txt": "text"}.get(files.suffix(args.output).split(".")[-1])
    if kind in ("geojson", "geojsonseq"):
        lines = exporting.geojson_features(made, config)
        if kind == "geojson":
            lines = _collection(lines)
        elif config.format_options.get("print_record_separator"):
            lines = lines.select(F.concat(F.lit("\x1e"), "json"))
    elif kind in ("pg", "text"):
        lines = (exporting.pg_features if kind == "pg" else exporting.text_features)(made, config)
    else:
        raise UsageError(f"Unknown export format {kind!r}")
    lines.write.mode("overwrite" if args.overwrite else "errorifexists").text(args.output)


def _collection(lines: DataFrame) -> DataFrame:
    """Features framed as one collection; commas stand before all but the first."""
    from waymill.scratch import numbered

    spark = lines.sparkSession
    rows = numbered(lines, [F.xxhash64("json"), F.col("json")], "n").select(F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "json").alias("text"), "n")
    edge = lambda t: spark.createDataFrame([(t,)], "text string").coalesce(1)
    return edge('{"type":"FeatureCollection","features":[').union(rows.orderBy("n").select("text")).union(edge("]}"))


def extract(args):
    d = _read(args, [args.input])
    options = {"types": None, "complete_percent": 100, "complete_tags": []}
    for setting in args.option or ():
        name, _, value = setting.partition("=")
        if name == "types":
            options["types"] = value.split(",")
        elif name == "complete-partial-relations":
            options["complete_percent"] = int(value)
        elif name == "tags":
            options["complete_tags"].append(value)
        elif name == "relations":
            options["relations"] = value != "false"
        else:
            raise UsageError(f"Unknown option {name!r}")
    if args.config:
        plans = {p.output: p for p in boundaries.read_extract_config(session(), args.config)}
        regions = {name: p.region for name, p in plans.items()}
    else:
        region = boundaries.of_box(args.bbox) if args.bbox else boundaries.read_boundary(session(), args.polygon)
        plans, regions = {}, {args.output: region}
    found = extracting.extract(merging.clean(d.df, args.clean or []), regions, args.strategy.replace("-", "_"), args.with_history, **options)
    from waymill.scratch import materialise

    found = materialise(found, "extracts")
    for name, region in regions.items():
        header = type(d.header)(d.header.options, (region.box,)) if args.set_bounds else d.header
        own = found.where(F.col("extract") == name).drop("extract")
        plan = plans.get(name)
        target = f"{args.directory}/{name}" if args.directory else name
        _save(args, Dataset(references.in_canonical_order(own), header, d.kind), target, plan.output_format if plan else args.output_format)


def fileinfo(args):
    d = _read(args, [args.input])
    out = {"file": {"name": args.input, "kind": d.kind}, "header": {"boxes": [[v / 1e7 for v in b] for b in d.header.boxes], "option": d.header.options}}
    if args.extended:
        counts = {r.type: r for r in summary.file_counts(d.df).collect()}
        facts, order = summary.file_facts(d.df).first(), summary.order_facts(d.df).first()
        iso = lambda t: t and t.strftime("%Y-%m-%dT%H:%M:%SZ")
        names = {"n": "nodes", "w": "ways", "r": "relations"}
        each = lambda f: {names[t]: getattr(r, f) if f != "count" else r["count"] for t, r in counts.items()}
        box = [facts.min_lon_e7, facts.min_lat_e7, facts.max_lon_e7, facts.max_lat_e7]
        out["data"] = {
            "bbox": None if box[0] is None else [v / 1e7 for v in box], "timestamp": {"first": iso(facts.first_timestamp), "last": iso(facts.last_timestamp)}, "objects_ordered": order.ordered, "multiple_versions": order.multiple_versions,
            "fingerprint": f"{summary.fingerprint(d.df).first().fingerprint & (1 << 64) - 1:016x}", "count": each("count"), "minid": each("min_id"), "maxid": each("max_id"),
        }
        marks = facts.asDict()
        out["metadata"] = {k: [n.partition("_")[2] for n, v in marks.items() if n.startswith(f"{k}_") and v] for k in ("all", "some")}
    if args.get:
        value = out
        for part in args.get.split("."):
            value = value[part]
        print(value if isinstance(value, str) else json.dumps(value))
    else:
        print(json.dumps(out, indent=2))


def getid(args):
    d, wanted = _read(args, [args.input]), _ids(args)
    found = references.get_ids(d.df, wanted, args.add_referenced, args.with_history, args.remove_tags)
    _write(args, Dataset(found.orderBy("_src", "_seq"), d.header, d.kind))
    lost = references.missing_ids(d.df, wanted, args.add_referenced)
    if args.verbose:
        for row in lost.toLocalIterator():
            print(f"missing: {row.type}{row.id}", file=sys.stderr)
    return int(not lost.isEmpty())


def getparents(args):
    d = _read(args, [args.input])
    _write(args, Dataset(references.get_parents(d.df, _ids(args), args.add_self).orderBy("_src", "_seq"), d.header, d.kind))


def help_(args):
    parser().print_help()


def merge(args):
    inputs = _each(args, args.input)
    for df in inputs if len(inputs) > 1 else ():
        errors = {r.kind: r["count"] for r in merging.order_errors(df).collect()}
        if errors:
            raise ValueError(f"Input out of order: {errors}")
        if not args.with_history and summary.order_facts(df).first().multiple_versions:
            print("An input has several versions of an object; use --with-history if it is meant to", file=sys.stderr)
    d = _read(args, args.input[:1])
    _write(args, Dataset(references.in_canonical_order(merging.merge(inputs)), d.header, d.kind))


def merge_changes(args):
    _write(args, Dataset(references.in_canonical_order(merging.merge_changes(_each(args, args.input), args.simplify)), kind="change"))


def query_locations_index(args):
    index = locations.read_index(session(), args.index_file)
    if args.dump:
        _print(opl.lines(merging.clean(_as_nodes(locations.dump_index(index)), [])))
        return 0
    try:
        lon, lat = locations.location_of(index, args.node_id)
    except KeyError:
        print("not found", file=sys.stderr)
        return 1
    print(f"{lon / 1e7:g} {lat / 1e7:g}")
    return 0


def _as_nodes(index: DataFrame) -> DataFrame:
    from waymill.model import as_objects

    return as_objects(index)


def removeid(args):
    d = _read(args, [args.input])
    _write(args, Dataset(references.remove_ids(d.df, _ids(args)).orderBy("_src", "_seq"), d.header, d.kind))


def renumber(args):
    d = _read(args, [args.input])
    types = "".join(t[0] for t in args.object_type) if args.object_type else "nwr"
    parts = [int(x) for x in args.start_id.split(",")] if args.start_id else [1]
    if len(parts) not in (1, 3):
        raise UsageError("One or three start ids")
    starts = dict(zip("nwr", parts * 3 if len(parts) == 1 else parts, strict=True))
    before = None
    if args.index_directory:
        if files.exists(session(), args.index_directory):
            before = session().read.parquet(args.index_directory)
    mapping = renumbering.renumber_map(d.df, starts, types, before)
    if args.show_index:
        kind = args.show_index[0]
        _print(mapping.where(F.col("type") == kind).orderBy("new_id").select(F.concat_ws(" ", F.col("old_id").cast("string"), F.col("new_id").cast("string"))))
        return
    from waymill.scratch import materialise

    mapping = materialise(mapping, "renumber")
    if args.index_directory:
        mapping.write.mode("overwrite").parquet(args.index_directory)
    _write(args, Dataset(renumbering.renumber(d.df, mapping).orderBy("_src", "_seq"), d.header, d.kind))


def show(args):
    """Objects for reading, page by page on a terminal."""
    df = _types(args, _read(args, [args.input]).df).orderBy("_src", "_seq")
    form = args.output_format or "debug"
    with _pager(not args.no_pager):
        if form == "debug":
            _print(debug.blocks(df, color=args.color))
        elif form == "opl":
            _print(opl.lines(df))
        else:
            first, last = xmlfile.frame(_read(args, [args.input]).header)
            print(first)
            _print(xmlfile.elements(df).select("xml"))
            print(last)


@contextlib.contextmanager
def _pager(wanted: bool):
    """What is printed goes through the program that PAGER names (less by default) if it goes to a terminal."""
    command = shlex.split(os.environ.get("PAGER", "less -R"))
    if not (wanted and sys.stdout.isatty() and command and shutil.which(command[0])):
        yield
        return
    viewer = subprocess.Popen(command, stdin=subprocess.PIPE, text=True)
    try:
        with contextlib.redirect_stdout(viewer.stdin):
            yield
    except BrokenPipeError:  # the reader has seen enough
        pass
    finally:
        with contextlib.suppress(BrokenPipeError):
            viewer.stdin.close()
        viewer.wait()


def sort(args):
    _write(args, merging.sort_datasets([_read(args, [p]) for p in args.input]))


def tags_count(args):
    df = _types(args, _read(args, [args.input]).df)
    counts = summary.tags_count(df, _expressions(args) or None, args.min_count, args.max_count)
    _print(summary.count_lines(summary.sorted_counts(counts, args.sort)))


def tags_filter(args):
    d = _read(args, [args.input])
    found = filters.tags_filter(_types(args, d.df), _expressions(args), args.invert_match, not args.omit_referenced, args.remove_tags)
    _write(args, Dataset(found.orderBy("_src", "_seq"), d.header, d.kind))


def time_filter(args):
    d = _read(args, [args.input])
    times = [time_of(t) for t in args.time] or [datetime.now(UTC)]
    if len(times) == 2 and times[0] > times[1]:
        raise UsageError("The second time comes before the first")
    found = filters.time_filter(d.df, *times[:2])
    _write(args, Dataset(found.orderBy("_src", "_seq"), d.header, "history" if len(times) == 2 else "data"))


_ID_FLAGS = [("ids", {"nargs": "*", "default": []}), ("--id-file -i", {"action": "append"}), ("--id-osm-file -I", {"action": "append"}), ("--default-type", {"default": "node"})]
_ON = {"action": "store_true"}
_MANY, _ONE, _OUT = ("input", {"nargs": "+"}), ("input", {}), ("--output -o", {"required": True})
_CLEAN, _TYPE = ("--clean -c", {"action": "append"}), ("--object-type -t", {"action": "append"})
_FILE = ("--expressions -e", {})
#: Command: its function and arguments.
COMMANDS: dict = {
    "add-locations-to-ways": (add_locations_to_ways, [_MANY, _OUT, ("--keep-untagged-nodes -n", _ON), ("--keep-member-nodes", _ON), ("--ignore-missing-nodes", _ON)]),
    "apply-changes": (apply_changes, [_ONE, ("changes", {"nargs": "+"}), _OUT, ("--with-history -H", _ON), ("--redact", _ON), ("--locations-on-ways", _ON)]),
    "cat": (cat, [_MANY, _OUT, _TYPE, _CLEAN]),
    "changeset-filter": (changeset_filter, [_ONE, _OUT, ("--with-discussion -d", _ON), ("--without-discussion -D", _ON), ("--with-changes -c", _ON), ("--without-changes -C", _ON), ("--open", _ON), ("--closed", _ON), ("--uid -U", {"type": int}), ("--user -u", {}), ("--after -a", {}), ("--before -b", {}), ("--bbox -B", {})]),
    "check-refs": (check_refs, [_ONE, ("--check-relations -r", _ON), ("--show-ids -i", _ON)]),
    "create-locations-index": (create_locations_index, [_ONE, ("--index-file -i", {"required": True}), ("--update -u", _ON)]),
    "derive-changes": (derive_changes, [("input", {"nargs": 2}), _OUT, ("--increment-version", _ON), ("--keep-details", _ON), ("--update-timestamp", _ON)]),
    "diff": (diff, [("input", {"nargs": 2}), _TYPE, ("--ignore-changeset", _ON), ("--ignore-uid", _ON), ("--ignore-user", _ON), ("--suppress-common -c", _ON), ("--summary -s", _ON), ("--quiet -q", _ON)]),
    "export": (export, [_ONE, _OUT, ("--config -c", {}), ("--add-unique-id -u", {"choices": ["counter", "type_id"]}), ("--geometry-types", {}), ("--keep-untagged -n", _ON), ("--show-errors -e", _ON), ("--stop-on-error -E", _ON)]),
    "extract": (extract, [_ONE, ("--output -o", {}), ("--bbox -b", {}), ("--polygon -p", {}), ("--config -c", {}), ("--directory -d", {}), ("--strategy -s", {"default": "complete_ways"}), ("--option -S", {"action": "append"}), ("--with-history -H", _ON), ("--set-bounds", _ON), ("--clean", {"action": "append"})]),
    "fileinfo": (fileinfo, [_ONE, ("--extended -e", _ON), ("--get -g", {}), ("--json -j", _ON)]),
    "getid": (getid, [_ONE, *_ID_FLAGS, _OUT, ("--add-referenced -r", _ON), ("--remove-tags", _ON), ("--with-history -H", _ON), ("--verbose", _ON)]),
    "getparents": (getparents, [_ONE, *_ID_FLAGS, _OUT, ("--add-self -s", _ON)]),
    "help": (help_, [("topic", {"nargs": "?"})]),
    "merge": (merge, [_MANY, _OUT, ("--with-history -H", _ON)]),
    "merge-changes": (merge_changes, [_MANY, _OUT, ("--simplify -s", _ON)]),
    "query-locations-index": (query_locations_index, [("node_id", {"nargs": "?", "type": int}), ("--index-file -i", {"required": True}), ("--dump", _ON)]),
    "removeid": (removeid, [_ONE, *_ID_FLAGS, _OUT]),
    "renumber": (renumber, [_ONE, ("--output -o", {}), _TYPE, ("--start-id -s", {}), ("--index-directory -i", {}), ("--show-index", {})]),
    "show": (show, [_ONE, _TYPE, ("--color -C", _ON), ("--no-pager -P", _ON)]),
    "sort": (sort, [_MANY, _OUT, ("--strategy", {"default": "simple", "choices": ["simple", "multipass"]})]),
    "tags-count": (tags_count, [_ONE, ("expression", {"nargs": "*"}), _FILE, _TYPE, ("--min-count -m", {"type": int}), ("--max-count -M", {"type": int}), ("--sort", {"default": "count-desc"})]),
    "tags-filter": (tags_filter, [_ONE, ("expression", {"nargs": "*"}), _FILE, _OUT, _TYPE, ("--invert-match -i", _ON), ("--omit-referenced -R", _ON), ("--remove-tags", _ON)]),
    "time-filter": (time_filter, [_ONE, ("time", {"nargs": "*"}), _OUT]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="waymill", description="Map data on Spark. Outputs are folders of part files.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (run, arguments) in COMMANDS.items():
        one = commands.add_parser(name, help=(run.__doc__ or name.replace("-", " ")).splitlines()[0])
        one.set_defaults(run=run)
        one.add_argument("--input-format", "-F")
        one.add_argument("--output-format", "-f")
        one.add_argument("--overwrite", "-O", action="store_true")
        one.add_argument("--output-header", action="append")
        one.add_argument("--join", action="store_true", help="write one local file")
        for flags, options in arguments:
            one.add_argument(*flags.split(), **options)
    return top


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0) and 2
    try:
        return int(args.run(args) or 0)
    except UsageError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001  whatever went wrong is told in a line
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1

"""XML data, history, change and changeset files."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from xml.etree.ElementTree import iterparse
from xml.parsers import expat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymill.functions.geometry import decimal
from waymill.model import CHANGESETS, Header, as_objects
from waymill.scratch import materialise

#: Elements that are objects.
_ROWS = ("node", "way", "relation")
TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_DECLARATION = "<?xml version='1.0' encoding='UTF-8'?>"


def _e7(c: Column) -> Column:
    return F.round(c * 10_000_000).cast("int")


def read(spark: SparkSession, path: str, src: int = 0) -> DataFrame:
    """Objects of a data or history file, read by splits of any size; rows are numbered in the order of the file
    within their kind, nodes before ways before relations. A folder of parts is one file, joined by name."""
    found = by_stretches(spark, path, src)
    rank = F.when(F.col("type") == "n", 0).when(F.col("type") == "w", 1).otherwise(2).cast("bigint")
    return found.withColumn("_seq", F.col("_seq") + rank * F.lit(1 << 61))


def _e7_of(text: str | None) -> int | None:
    """Exact for decimals; halves are rounded away from zero."""
    return None if text is None else int((Decimal(text) * 10_000_000).quantize(1, ROUND_HALF_UP))


def parse_events(data: bytes) -> Iterator[dict]:
    """Objects in the order of the file; what stands in a delete section is not visible."""
    action, seq = None, 0
    for event, element in iterparse(io.BytesIO(data), events=("start", "end")):
        if element.tag in ("create", "modify", "delete"):
            action = element.tag if event == "start" else None
        if event == "start" or element.tag not in _ROWS:
            continue
        a, letter = element.attrib, element.tag[0]
        row = {
            "type": letter, "id": int(a["id"]), "version": int(a.get("version", 0)), "visible": action != "delete" and a.get("visible", "true") != "false", "timestamp": a.get("timestamp"),
            "changeset": int(a.get("changeset", 0)), "uid": int(a.get("uid", 0)), "user": a.get("user", ""), "tags": [{"k": t.get("k", ""), "v": t.get("v", "")} for t in element.iter("tag")],
            "lon_e7": _e7_of(a.get("lon")), "lat_e7": _e7_of(a.get("lat")), "refs": None, "members": None, "_seq": seq,
        }
        if letter == "w":
            row["refs"] = [{"ref": int(n.get("ref")), "lon_e7": _e7_of(n.get("lon")), "lat_e7": _e7_of(n.get("lat"))} for n in element.iter("nd")]
        elif letter == "r":
            row["members"] = [{"type": m.get("type")[0], "ref": int(m.get("ref")), "role": m.get("role", "")} for m in element.iter("member")]
        seq += 1
        yield row
        element.clear()


PARSED = "type string, id bigint, version int, visible boolean, timestamp string, changeset bigint, uid int, user string, tags array<struct<k:string,v:string>>, lon_e7 int, lat_e7 int, refs array<struct<ref:bigint,lon_e7:int,lat_e7:int>>, members array<struct<type:string,ref:bigint,role:string>>, _seq bigint"
_TAG = pa.struct([("k", pa.string()), ("v", pa.string())])
PARSED_ARROW = pa.schema(
    [
        ("type", pa.string()), ("id", pa.int64()), ("version", pa.int32()), ("visible", pa.bool_()), ("timestamp", pa.string()), ("changeset", pa.int64()), ("uid", pa.int32()), ("user", pa.string()), ("tags", pa.list_(_TAG)), ("lon_e7", pa.int32()), ("lat_e7", pa.int32()),
        ("refs", pa.list_(pa.struct([("ref", pa.int64()), ("lon_e7", pa.int32()), ("lat_e7", pa.int32())]))), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("_seq", pa.int64()),
    ]
)


def parsed_files(spark: SparkSession, path: str, parser, src: int = 0) -> DataFrame:
    """Objects of whole files, each parsed by one task: parser(bytes) gives rows of PARSED."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for row in parser(content.as_py()):
                    rows.append(row)
                    if len(rows) == 5_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=PARSED_ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=PARSED_ARROW)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PARSED)
    return as_objects(found.withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit(TIME))).withColumn("_src", F.lit(src)), src)


def _plain(parser):
    def run(data: bytes):
        import bz2
        import gzip

        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        elif data[:3] == b"BZh":
            data = bz2.decompress(data)
        return parser(data)

    return run


def read_changes(spark: SparkSession, path: str, src: int = 0) -> DataFrame:
    """Objects of a change file, or of any file whose order matters, numbered in that order; read by splits of any size.

    Only a packed file whose name doesn't say so goes whole to one task.
    """
    return parsed_files(spark, path, _plain(parse_events), src) if _packed_unnamed(spark, path) else by_stretches(spark, path, src)


# --- reading by stretches -------------------------------------------------------------------------

#: A row's number is that of its split and, in so many bits, its place in the split.
SPLIT_BITS = 36
_START = re.compile(rb"<(?:node|way|relation)(?=[\s/>])")
_SECTION = re.compile(rb"<(/?)(create|modify|delete)\b[^>]*?(/?)>")
_COMMENT = re.compile(rb"<!--.*?-->", re.DOTALL)
_PIECES = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("synced", pa.bool_()), ("head", pa.binary()), ("tail", pa.binary()), ("before", pa.string()), ("section", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("value").cast("binary").alias("bytes"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))


def _packed_unnamed(spark: SparkSession, path: str) -> bool:
    found = sorted(spark.read.text(path).inputFiles())
    if not found or found[0].endswith((".gz", ".bz2")):
        return False
    head = _lines(spark, found[0]).limit(1).collect()
    return bool(head) and bytes(head[0].bytes)[:3].startswith((b"\x1f\x8b", b"BZh"))


def _chunks(batches) -> Iterator[tuple[tuple[str, int], bytes]]:
    """(split, bytes) as they come; line feeds are put back."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = lambda i: (batch.column(1)[i].as_py(), batch.column(2)[i].as_py())  # noqa: B023, E731
        at = 0
        while at < n:
            now, end = key(at), n
            if key(n - 1) != now:  # a split's lines follow each other
                low, end = at, n - 1
                while end - low > 1:
                    middle = (low + end) // 2
                    low, end = (middle, end) if key(middle) == now else (low, middle)
            column = batch.column(0).slice(at, end - at)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), b"\n")
            yield now, joined[0].as_py() + b"\n"
            at = end


def _section_of(data: bytes, now: str | None) -> str | None:
    """The section after these bytes: its name, or none where one ended; as it was if they say nothing."""
    found = None
    for found in _SECTION.finditer(data):  # noqa: B007
        pass
    return now if found is None else "none" if found[1] or found[3] else found[2].decode()


class _Stretch:
    """One split of a file: bytes before its first object, whole objects, and the last one, which may go on in the next split."""

    def __init__(self, key: tuple[str, int]):
        self.key, self.head, self.data = key, None, b""

    def add(self, data: bytes) -> bytes:
        """What lies between the first object and the beginning of the last so far, and hasn't been given yet."""
        self.data += data
        if b"<!--" in self.data:
            self.data = _COMMENT.sub(b"", self.data)
        first = _START.search(self.data)
        if first is None:
            return b""
        if self.head is None:
            self.head, self.data = self.data[: first.start()], self.data[first.start() :]
        at = max(self.data.rfind(b"<node"), self.data.rfind(b"<way"), self.data.rfind(b"<relation"))
        while at > 0 and not _START.match(self.data, at):
            at = max(self.data.rfind(b"<node", 0, at), self.data.rfind(b"<way", 0, at), self.data.rfind(b"<relation", 0, at))
        body, self.data = self.data[:at], self.data[at:]
        return body


def _stretches(batches) -> Iterator[tuple[_Stretch, bytes, bool]]:
    """Each split with its objects as they come; True at its end."""
    now: _Stretch | None = None
    for key, data in _chunks(batches):
        if now is None or now.key != key:
            if now is not None:
                yield now, b"", True
            now = _Stretch(key)
        yield now, now.add(data), False
    if now is not None:
        yield now, b"", True


def _seams(batches) -> Iterator[pa.RecordBatch]:
    """What each split has before its first object and from its last on, and the section before and after the last one."""
    section = None
    for stretch, body, ended in _stretches(batches):
        section = _section_of(body, section)
        if ended:
            synced = stretch.head is not None
            head, tail = (stretch.head, stretch.data) if synced else (stretch.data, b"")
            before = section or _section_of(head, None)
            values = (*stretch.key, synced, head, tail, before, _section_of(tail, before))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _PIECES, strict=True)], schema=_PIECES)
            section = None


class _Rows:
    """Columns of PARSED, filled by a parser's events."""

    def __init__(self):
        self.section: str | None = None
        self.clear()

    def clear(self) -> None:
        self.columns: dict[str, list] = {n: [] for n in ("type", "id", "version", "visible", "timestamp", "changeset", "uid", "user", "lon_e7", "lat_e7", "_seq")}
        self.tags, self.refs, self.members = ([0], [], []), ([0], [], [], []), ([0], [], [], [])

    def start(self, name: str, a: dict[str, str]) -> None:
        if name == "nd":
            _, refs, lons, lats = self.refs
            refs.append(int(a["ref"]))
            lons.append(_e7_of(a.get("lon")))
            lats.append(_e7_of(a.get("lat")))
        elif name == "tag":
            self.tags[1].append(a.get("k", ""))
            self.tags[2].append(a.get("v", ""))
        elif name == "member":
            self.members[1].append(a["type"][0])
            self.members[2].append(int(a["ref"]))
            self.members[3].append(a.get("role", ""))
        elif name in _ROWS:
            c, get = self.columns, a.get
            c["type"].append(name[0])
            c["id"].append(int(a["id"]))
            c["version"].append(int(get("version", 0)))
            c["visible"].append(self.section != "delete" and get("visible", "true") != "false")
            c["timestamp"].append(get("timestamp"))
            c["changeset"].append(int(get("changeset", 0)))
            c["uid"].append(int(get("uid", 0)))
            c["user"].append(get("user", ""))
            c["lon_e7"].append(_e7_of(get("lon")))
            c["lat_e7"].append(_e7_of(get("lat")))
        elif name == "section":
            self.section = a.get("name")

    def end(self, name: str) -> None:
        if name in _ROWS:
            for lists in (self.tags, self.refs, self.members):
                lists[0].append(len(lists[1]))

    def parse(self, body: bytes) -> None:
        """Whole objects, between which sections begin and end."""
        if _SECTION.search(body):
            body = _SECTION.sub(lambda m: b"<section/>" if m[1] or m[3] else b'<section name="' + m[2] + b'"/>', body)
        parser = expat.ParserCreate("UTF-8")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler = self.start, self.end
        parser.Parse(b"<osm>" + body + b"</osm>", True)

    def parse_first(self, data: bytes) -> None:
        """The object that these bytes begin with; what follows closes what began before."""
        whole = len(self.columns["id"]) + 1
        parser = expat.ParserCreate("UTF-8")
        parser.StartElementHandler, parser.EndElementHandler = self.start, self.end
        try:
            parser.Parse(data, False)
        except expat.ExpatError:
            if len(self.tags[0]) <= whole:
                raise
        if len(self.tags[0]) <= whole:
            raise ValueError("A file ends within an object")

    def batch(self) -> pa.RecordBatch:
        kinds = self.columns["type"]

        def lists(found, field: pa.Field, kind: str | None) -> pa.Array:
            inner = field.type.value_type
            values = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(found[1:], inner, strict=True)], fields=list(inner))
            mask = pa.array([k != kind for k in kinds], pa.bool_()) if kind else None
            return pa.ListArray.from_arrays(pa.array(found[0], pa.int32()), values, type=field.type, mask=mask)

        special = {"tags": (self.tags, None), "refs": (self.refs, "w"), "members": (self.members, "r")}
        arrays = [lists(special[f.name][0], f, special[f.name][1]) if f.name in special else pa.array(self.columns[f.name], f.type) for f in PARSED_ARROW]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=PARSED_ARROW)


def by_stretches(spark: SparkSession, path: str, src: int = 0) -> DataFrame:
    """Objects of all files of a path in their order, decoded by splits (spark.sql.files.maxPartitionBytes); bzip2 is split, too.

    Objects don't nest and a < in a text is always quoted, so a split finds its first object for itself. A first pass
    keeps what each split has before that and from its last object on: these are put together, and what
    lies between is parsed where it is read. The driver sees a row for each split. A comment that holds the
    text of an object must not go over the end of a split.
    """
    lines = _lines(spark, path)
    pieces = materialise(lines.mapInArrow(_seams, "path string, begin bigint, synced boolean, head binary, tail binary, before string, section string"), "xml-seams")
    order = Window.orderBy("path", "begin")  # a row for each split
    ahead = F.last("section", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    known = pieces.select("path", "begin", "synced", (F.row_number().over(order) - 1).cast("bigint").alias("split"), F.sum(F.col("synced").cast("int")).over(order).alias("seam"), F.sum(F.when(F.col("begin") == 0, 1).otherwise(0)).over(order).alias("file"), ahead.alias("ahead"))
    known = materialise(known, "xml-splits")
    shared = spark.sparkContext.broadcast({(r.path, r.begin): (r.split, r.ahead) for r in known.collect()})

    def decode(batches):
        rows, last, seq = _Rows(), None, 0
        for stretch, body, _ in _stretches(batches):
            if body:
                if stretch is not last:
                    last = stretch
                    split, ahead = shared.value[stretch.key]
                    rows.section, seq = _section_of(stretch.head, ahead), split << SPLIT_BITS
                rows.parse(body)
                n = len(rows.columns["id"])
                rows.columns["_seq"] = list(range(seq, seq + n))
                seq += n
                yield rows.batch()

    parts = pieces.join(known.drop("synced"), ["path", "begin"])
    heads = parts.where("length(head) > 0").select("file", F.when(F.col("synced"), F.col("seam") - 1).otherwise(F.col("seam")).alias("seam"), F.struct("split", F.lit(0).alias("nth"), F.col("head").alias("bytes"), F.lit(None).cast("string").alias("section")).alias("p"))
    tails = parts.where("length(tail) > 0").select("file", "seam", F.struct("split", F.lit(1).alias("nth"), F.col("tail").alias("bytes"), F.coalesce("before", "ahead").alias("section")).alias("p"))
    joined = heads.union(tails).groupBy("file", "seam").agg(F.sort_array(F.collect_list("p")).alias("parts"))

    def mend(batches):
        rows = _Rows()
        for batch in batches:
            for found in batch.column(0).to_pylist():
                if found[0]["nth"]:  # else it is what stands before the first object of a file
                    rows.section = found[0]["section"]
                    rows.parse_first(b"".join(p["bytes"] for p in found))
                    rows.columns["_seq"].append((found[0]["split"] + 1 << SPLIT_BITS) - 1)
            yield rows.batch()

    found = lines.mapInArrow(decode, PARSED).unionByName(joined.select("parts").mapInArrow(mend, PARSED))
    return as_objects(found.withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit(TIME))).withColumn("_src", F.lit(src)), src)


def read_changesets(spark: SparkSession, path: str) -> DataFrame:
    """Changesets of a file."""
    schema = "_id bigint, _created_at string, _closed_at string, _open boolean, _num_changes int, _comments_count int, _uid int, _user string, _min_lon decimal(12,8), _min_lat decimal(12,8), _max_lon decimal(12,8), _max_lat decimal(12,8), tag array<struct<_k string, _v string>>"
    rows = spark.read.format("xml").option("rowTag", "changeset").schema(schema).load(path)
    time = lambda c: F.try_to_timestamp(c, F.lit(TIME))
    zero = lambda c: F.coalesce(c, F.lit(0))
    columns = [
        F.col("_id"), time("_created_at"), time("_closed_at"), F.coalesce("_open", F.col("_closed_at").isNull()), zero("_num_changes"), zero("_comments_count"), zero("_uid"), F.coalesce("_user", F.lit("")),
        *[_e7(F.col(c)) for c in ("_min_lon", "_min_lat", "_max_lon", "_max_lat")], F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>")),
    ]
    return rows.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(columns, CHANGESETS.fields, strict=True)])


def read_header(spark: SparkSession, path: str) -> Header:
    """Options and boxes, from what stands before the first object."""
    parts = sorted(spark.read.text(path).inputFiles())
    head = "\n".join(r.value for r in spark.read.text(parts[0]).limit(20).collect()) if parts else ""
    head = head[: min([head.find(f"<{t} ") for t in (*_ROWS, "create", "modify", "delete") if f"<{t} " in head], default=len(head))]
    attributes = dict(re.findall(r'([\w.]+)=["\']([^"\']*)["\']', (re.search(r"<osm(?:Change)?\b([^>]*)>", head) or [None, ""])[1]))
    boxes = []
    for text in re.findall(r"<bounds\b([^>]*)>", head):
        b = dict(re.findall(r'(\w+)=["\']([^"\']*)["\']', text))
        boxes.append(tuple(_e7_of(b[k]) for k in ("minlon", "minlat", "maxlon", "maxlat")))
    return Header(attributes, tuple(boxes))


def _quoted(c: Column) -> Column:
    quoted = c
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\n", "&#xA;"), ("\r", "&#xD;"), ("\t", "&#x9;")):
        quoted = F.replace(quoted, F.lit(plain), F.lit(code))
    return F.when(c.rlike("[&<>\"'\n\r\t]"), quoted).otherwise(c)


def _attribute(name: str, value: Column, unless: Column | None = None) -> Column:
    text = F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))
    return F.coalesce(text if unless is None else F.when(~unless, text), F.lit(""))


def elements(objects: DataFrame, visible: bool = False) -> DataFrame:
    """(xml, action) of each object; visible writes that attribute. action: the section of a change file that it belongs to."""
    tag = F.transform("tags", lambda t: F.concat(F.lit('    <tag k="'), _quoted(t["k"]), F.lit('" v="'), _quoted(t["v"]), F.lit('"/>\n')))
    place = lambda r: F.coalesce(F.concat(F.lit(' lat="'), decimal(r["lat_e7"]), F.lit('" lon="'), decimal(r["lon_e7"]), F.lit('"')), F.lit(""))
    refs = F.transform("refs", lambda r: F.concat(F.lit('    <nd ref="'), r["ref"].cast("string"), F.lit('"'), place(r), F.lit("/>\n")))
    names = lambda c: F.when(c == "n", "node").when(c == "w", "way").otherwise("relation")
    members = F.transform("members", lambda m: F.concat(F.lit('    <member type="'), names(m["type"]), F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), _quoted(m["role"]), F.lit('"/>\n')))
    inner = F.concat(F.coalesce(F.array_join(refs, ""), F.lit("")), F.coalesce(F.array_join(members, ""), F.lit("")), F.array_join(tag, ""))
    head = F.concat(
        F.lit("  <"), names(F.col("type")), _attribute("id", F.col("id")), _attribute("version", F.col("version"), F.col("version") == 0),
        _attribute("timestamp", F.date_format("timestamp", TIME)), _attribute("uid", F.col("uid"), F.col("uid") == 0), _attribute("user", _quoted(F.col("user")), F.col("user") == ""), _attribute("changeset", F.col("changeset"), F.col("changeset") == 0),
        _attribute("visible", F.col("visible")) if visible else F.lit(""), F.when(F.col("type") == "n", F.concat(_attribute("lat", decimal(F.col("lat_e7"))), _attribute("lon", decimal(F.col("lon_e7"))))).otherwise(""),
    )
    whole = F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">\n"), inner, F.lit("  </"), names(F.col("type")), F.lit(">")))
    action = F.when(~F.col("visible"), "delete").when(F.col("version") == 1, "create").otherwise("modify")
    return objects.select(whole.alias("xml"), action.alias("action"))


def frame(header: Header, change: bool = False) -> tuple[str, str]:
    """What stands before and after the elements of a file."""
    root = "osmChange" if change else "osm"
    options = {"version": "0.6", "generator": "waymill"} | {k: v for k, v in header.options.items() if k in ("version", "generator", "upload")}
    lines = [_DECLARATION, f"<{root} " + " ".join(f'{k}="{v}"' for k, v in options.items()) + ">"]
    lines += [f'  <bounds minlat="{b / 1e7:.7f}" minlon="{a / 1e7:.7f}" maxlat="{d / 1e7:.7f}" maxlon="{c / 1e7:.7f}"/>' for a, b, c, d in header.boxes]
    return "\n".join(lines), f"</{root}>"

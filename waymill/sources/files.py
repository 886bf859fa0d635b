"""Reading and writing files by format."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.model import Dataset, Header
from waymill.operators.merging import clean, concatenate
from waymill.sources import debug, o5m, opl, pbf, xmlfile

_COMPRESSIONS = {"gz": "gzip", "bz2": "bzip2"}
#: Suffix: encoding, kind of file.
_FORMATS = {"osm": ("xml", "data"), "osh": ("xml", "history"), "osc": ("xml", "change"), "xml": ("xml", "data"), "pbf": ("pbf", "data"), "opl": ("opl", "data"), "o5m": ("o5m", "data"), "o5c": ("o5m", "change"), "debug": ("debug", "data"), "parquet": ("parquet", "data")}


@dataclass(frozen=True)
class Format:
    encoding: str
    kind: str = "data"
    compression: str | None = None
    options: tuple[tuple[str, str], ...] = ()

    def option(self, name: str, default: str = "") -> str:
        return dict(self.options).get(name, default)


def suffix(path: str) -> str:
    """What follows the first dot of a file's name."""
    return posixpath.basename(path).partition(".")[2]


def resolve(path: str, override: str | None = None) -> Format:
    """The format of a path by its suffix, or as given: ``osm.bz2``, ``opl``, ``pbf,add_metadata=false``."""
    if path in ("", "-") and not override:
        raise ValueError("Standard input and output need a format")
    name, *settings = (override or suffix(path)).split(",")
    options = tuple((k, v or "true") for k, _, v in (s.partition("=") for s in settings))
    parts = name.split(".")
    compression = _COMPRESSIONS.get(parts[-1])
    if compression:
        parts = parts[:-1]
    known = [p for p in parts if p in _FORMATS]
    if not known:
        raise ValueError(f"Unknown format {name!r}")
    encoding = _FORMATS[known[-1]][0]
    kind = next((_FORMATS[p][1] for p in known if _FORMATS[p][1] != "data"), "data")
    if dict(options).get("history") == "true":
        kind = "history"
    if encoding == "pbf" and compression:
        raise ValueError("The binary format has a compression of its own")
    return Format(encoding, kind, compression, options)


def read(spark: SparkSession, paths: list[str], override: str | None = None) -> Dataset:
    """Objects of several files; _src is the place of the file. The header is the first one's."""
    parts, header, kind = [], Header(), "data"
    for i, path in enumerate(paths):
        form = resolve(path, override)
        if form.encoding == "opl":
            df = opl.read(spark, path, i)
        elif form.encoding == "pbf":
            df, own = pbf.read(spark, path, i), pbf.read_header(spark, path)
        elif form.encoding == "o5m":
            df = o5m.read(spark, path, i)
        elif form.encoding == "parquet":
            df = spark.read.parquet(path)
        elif form.encoding == "xml":
            df = (xmlfile.read_changes if form.kind == "change" else xmlfile.read)(spark, path, i)
            own = xmlfile.read_header(spark, path)
        else:
            raise ValueError(f"{form.encoding} can't be read")
        if i == 0:
            header, kind = (own if form.encoding in ("pbf", "xml") else Header()), form.kind
        parts.append(df)
    return Dataset(concatenate(parts), header, kind)


def write(dataset: Dataset, path: str, override: str | None = None, overwrite: bool = False, settings: list[str] | None = None) -> None:
    """Write objects to a folder of part files in the order of the rows; an existing one is an error unless overwrite.

    The parts joined by name are a file of the format: frames of XML and the header block of
    the binary format are parts of their own.
    """
    form = resolve(path, override)
    mode = "overwrite" if overwrite else "errorifexists"
    df, header = dataset.df, dataset.header.merged(settings or [])
    spark = df.sparkSession
    if form.encoding == "parquet":
        df.write.mode(mode).parquet(path)
        return
    kept = {"false": "none", "true": "all"}.get(form.option("add_metadata", "all"), form.option("add_metadata", "all"))
    if kept != "all":
        df = clean(df, [a for a in ("version", "timestamp", "changeset", "uid", "user") if a not in kept.split("+")])
    with_places = form.option("locations_on_ways") == "true"
    if form.encoding == "opl":
        text = opl.lines(df, with_places)
    elif form.encoding == "debug":
        text = debug.blocks(df, form.option("add_crc32") == "true", form.option("use_color") == "true")
    elif form.encoding == "pbf":
        compress = {"true": "zlib", "false": "none"}.get(form.option("pbf_compression", "zlib"), form.option("pbf_compression", "zlib"))
        if compress not in ("zlib", "lz4", "none"):
            raise ValueError(f"Unknown compression {compress!r}")
        head = spark.createDataFrame([(pbf.header_block(header, form.kind == "history", with_places, compress),)], "block binary").coalesce(1)
        text = pbf.as_lines(head.unionByName(pbf.encoded(df, with_places, compress, form.option("pbf_dense_nodes") != "false")))
    elif form.encoding == "xml":
        change = form.kind == "change" or form.option("xml_change_format") == "true"
        body = xmlfile.elements(df, form.kind == "history" or form.option("force_visible_flag") == "true")
        line = F.concat(F.lit("<"), "action", F.lit(">\n"), "xml", F.lit("\n</"), "action", F.lit(">")) if change else F.col("xml")
        first, last = xmlfile.frame(header, change)
        edge = lambda t: spark.createDataFrame([(t,)], "text string").coalesce(1)
        text = edge(first).union(body.select(line)).union(edge(last))
    else:
        raise ValueError(f"{form.encoding} can't be written")
    text.write.mode(mode).option("compression", form.compression or "none").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name, on whatever file system the name says."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def join_parts(folder: str, target: str) -> None:
    """Put the parts of a local folder together to one local file: what command-line use ends with."""
    import glob
    import shutil

    with open(target, "wb") as out:
        for part in sorted(glob.glob(f"{folder}/part-*")):
            with open(part, "rb") as source:
                shutil.copyfileobj(source, out)

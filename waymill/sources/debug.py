"""A form for reading by people; written only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.functions.geometry import decimal


def _names(c: Column) -> Column:
    return F.when(c == "n", "node").when(c == "w", "way").otherwise("relation")


def _numbered(items: Column, one) -> Column:
    """Lines of an array, its places right-aligned as wide as the last needs."""
    width = F.length((F.size(items) - 1).cast("string"))
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("    "), F.lpad(i.cast("string"), width, " "), F.lit(": "), one(x))), "\n")


def blocks(objects: DataFrame, crc: bool = False, color: bool = False) -> DataFrame:
    """(text) of each object, ended by an empty line; crc adds a checksum of the content, color marks of terminals."""
    mark = lambda code, text: F.concat(F.lit(f"\x1b[{code}m"), text, F.lit("\x1b[0m")) if color else text
    line = lambda name, value: F.concat(mark("36", F.rpad(F.lit(f"  {name}:"), 13, " ")), value)
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    head = F.concat(_names(F.col("type")), F.lit(" "), "id", F.when(F.col("visible"), " visible").otherwise(" deleted"))
    longest = F.array_max(F.transform("tags", lambda t: F.length(t["k"])))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("    "), quoted(t["k"]), F.repeat(F.lit(" "), longest - F.length(t["k"])), F.lit(" = "), quoted(t["v"]))), "\n")
    n = F.size("refs")
    closed = F.when((n > 0) & (F.get("refs", F.lit(0))["ref"] == F.get("refs", n - 1)["ref"]), "closed").otherwise("open")
    place = lambda r: F.when(r["lon_e7"].isNull(), "").otherwise(F.concat(F.lit(" ("), decimal(r["lon_e7"]), F.lit(","), decimal(r["lat_e7"]), F.lit(")")))
    parts = [
        F.when(F.col("visible"), mark("1", head)).otherwise(mark("1;31", head)),
        line("version", F.col("version").cast("string")),
        line("changeset", F.col("changeset").cast("string")),
        line("timestamp", F.coalesce(F.concat(time, F.lit(" ("), F.unix_timestamp("timestamp").cast("string"), F.lit(")")), F.lit("NOT SET"))),
        line("user", F.concat("uid", F.lit(" "), quoted(F.col("user")))),
        F.when(F.col("lon_e7").isNotNull(), line("lon/lat", F.concat(decimal(F.col("lon_e7")), F.lit(","), decimal(F.col("lat_e7"))))),
        F.when(F.size("tags") > 0, F.concat(line("tags", F.size("tags").cast("string")), F.lit("\n"), tags)),
        F.when(F.col("type") == "w", F.concat_ws("\n", line("nodes", F.concat(n.cast("string"), F.lit(" ("), closed, F.lit(")"))), F.when(n > 0, _numbered(F.col("refs"), lambda r: F.concat(F.lpad(r["ref"].cast("string"), 10, " "), place(r)))))),
        F.when(F.col("type") == "r", F.concat_ws("\n", line("members", F.size("members").cast("string")), F.when(F.size("members") > 0, _numbered(F.col("members"), lambda m: F.concat(_names(m["type"]), F.lit(" "), m["ref"].cast("string"), F.lit(" "), quoted(m["role"])))))),
    ]
    if crc:
        content = F.to_json(F.struct("type", "id", "version", "visible", "changeset", "uid", "user", "tags", "lon_e7", "lat_e7", "refs", "members"))
        parts.append(line("crc32", F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")))
    return objects.select(F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("text"))

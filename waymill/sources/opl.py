"""The line format: one object a line, fields by letter, special characters as %hex%. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.functions.geometry import decimal
from waymill.model import as_objects

# Characters that are written as they are.
_PLAIN = r"[\x21-\x24\x26-\x2b\x2d-\x3c\x3e-\x3f\x41-\x7e¡-¬®-׿]"
_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def unescaped(c: Column) -> Column:
    """Text with %hex% turned into characters."""
    parts = F.split(c, "%")
    character = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    return F.when(~F.contains(c, F.lit("%")), c).otherwise(F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, character(p)).otherwise(p)), ""))


def escaped(c: Column) -> Column:
    """Text with all characters that aren't plain turned into %hex%."""
    code = lambda ch: F.ltrim(F.lower(F.hex(F.encode(ch, "UTF-32"))), F.lit("0"))
    one = lambda ch: F.when(ch.rlike(f"^{_PLAIN}$"), ch).otherwise(F.concat(F.lit("%"), F.lpad(code(ch), F.greatest(F.length(code(ch)), F.lit(2)), F.lit("0")), F.lit("%")))
    return F.when(c.rlike(f"^{_PLAIN}*$"), c).otherwise(F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), one), ""))


def _field(letter: str) -> Column:
    """What follows the letter in the first field that begins with it, or null."""
    return F.when(F.contains("value", F.lit(f" {letter}")), F.regexp_extract("value", f" {letter}([^ ]*)", 1))


def _e7(c: Column) -> Column:
    return F.round(F.when(c != "", c).cast("decimal(12,8)") * 10_000_000).cast("int")


def _list(c: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), ","), "")


def _time(c: Column) -> Column:
    """A timestamp in the session's zone; null if it is none. Usual ones are read without a formatter, empty ones without its error."""
    usual = c.rlike(r"^[12][0-9]{3}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z")
    return F.when(usual, F.substring(c, 1, 19).try_cast("timestamp")).when(c != "", F.try_to_timestamp(c, F.lit(_TIME)))


def parse(lines: DataFrame, src: int = 0) -> DataFrame:
    """Objects from lines (columns value and _seq). Lines of other kinds and comments are left out."""
    rows = lines.where(F.col("value").rlike("^[nwr]-?[0-9]")).withColumns({"head": F.substring_index("value", " ", 1), "T": _field("T"), "N": F.replace(_field("N"), F.lit("n"), F.lit("")), "M": _field("M"), "at": _field("t")})

    def pair(read) -> Callable:
        return lambda t: F.struct(read(F.substring_index(t, "=", 1)).alias("k"), read(F.substring(t, F.length(F.substring_index(t, "=", 1)) + 2, F.length(t))).alias("v"))

    def ref(r: Column) -> Column:
        place = F.split(r, "[xy]")
        return F.struct(F.get(place, F.lit(0)).cast("bigint").alias("ref"), _e7(F.get(place, F.lit(1))).alias("lon_e7"), _e7(F.get(place, F.lit(2))).alias("lat_e7"))

    def member(read) -> Column:
        number = lambda m: F.regexp_extract(m, "^.(-?[0-9]+)", 1)
        return lambda m: F.struct(F.substring(m, 1, 1).alias("type"), number(m).cast("bigint").alias("ref"), read(F.substring(m, F.length(number(m)) + 3, F.length(m))).alias("role"))

    def listed(field: str, item) -> Column:
        """Items of a field; they are asked for escaped characters only if it has one."""
        return F.when(F.contains(field, F.lit("%")), F.transform(_list(F.col(field)), item(unescaped))).otherwise(F.transform(_list(F.col(field)), item(lambda c: c)))

    nowhere = F.lit(None).cast("int")
    plain = F.transform(_list(F.col("N")).cast("array<bigint>"), lambda r: F.struct(r.alias("ref"), nowhere.alias("lon_e7"), nowhere.alias("lat_e7")))
    refs = F.when(F.contains("N", F.lit("x")) | F.contains("N", F.lit("y")), F.transform(_list(F.col("N")), ref)).otherwise(plain)
    kind = F.substring("head", 1, 1)
    none = F.lit(None)
    return as_objects(
        rows.select(
            kind.alias("type"),
            F.substring(F.col("head"), F.lit(2), F.length("head")).cast("bigint").alias("id"),
            _field("v").cast("int").alias("version"),
            (F.coalesce(_field("d"), F.lit("V")) != "D").alias("visible"),
            _time(F.col("at")).alias("timestamp"),
            _field("c").cast("bigint").alias("changeset"),
            _field("i").cast("int").alias("uid"),
            unescaped(_field("u")).alias("user"),
            listed("T", pair).alias("tags"),
            F.when(kind == "n", _e7(_field("x"))).alias("lon_e7"),
            F.when(kind == "n", _e7(_field("y"))).alias("lat_e7"),
            F.when(kind == "w", refs).otherwise(none).alias("refs"),
            F.when(kind == "r", listed("M", member)).otherwise(none).alias("members"),
            F.lit(src).alias("_src"),
            "_seq",
        )
    )


def read(spark: SparkSession, path: str, src: int = 0) -> DataFrame:
    """Objects of one file (plain, gzip or bzip2), numbered in its order."""
    return parse(spark.read.text(path).withColumn("_seq", F.monotonically_increasing_id()), src)


def lines(objects: DataFrame, locations_on_ways: bool = False) -> DataFrame:
    """(line) of each object; with locations_on_ways refs are written with theirs."""
    place = lambda x, y: F.concat(F.lit("x"), F.coalesce(decimal(x), F.lit("")), F.lit("y"), F.coalesce(decimal(y), F.lit("")))
    ref = lambda r: F.concat(F.lit("n"), r["ref"].cast("string"), place(r["lon_e7"], r["lat_e7"]))
    refs = F.array_join(F.transform("refs", ref), ",")
    if not locations_on_ways:
        refs = F.when(F.size("refs") > 0, F.concat(F.lit("n"), F.array_join(F.col("refs.ref").cast("array<string>"), ",n")))
    member = lambda m: F.concat(m["type"], m["ref"].cast("string"), F.lit("@"), escaped(m["role"]))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(escaped(t["k"]), F.lit("="), escaped(t["v"]))), ",")
    common = F.concat(
        F.col("type"), F.col("id"), F.lit(" v"), F.col("version"), F.when(F.col("visible"), " dV").otherwise(" dD"), F.lit(" c"), F.col("changeset"),
        F.lit(" t"), F.coalesce(F.date_format("timestamp", _TIME), F.lit("")), F.lit(" i"), F.col("uid"), F.lit(" u"), escaped(F.col("user")), F.lit(" T"), tags,
    )
    rest = (
        F.when(F.col("type") == "n", F.concat(F.lit(" x"), F.coalesce(decimal(F.col("lon_e7")), F.lit("")), F.lit(" y"), F.coalesce(decimal(F.col("lat_e7")), F.lit(""))))
        .when(F.col("type") == "w", F.concat(F.lit(" N"), F.coalesce(refs, F.lit(""))))
        .otherwise(F.concat(F.lit(" M"), F.coalesce(F.array_join(F.transform("members", member), ","), F.lit(""))))
    )
    return objects.select(F.concat(common, rest).alias("line"))


def changeset_lines(changesets: DataFrame) -> DataFrame:
    """(line) of each changeset."""
    time = lambda c: F.coalesce(F.date_format(c, _TIME), F.lit(""))
    side = lambda c: F.coalesce(decimal(F.col(c)), F.lit(""))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(escaped(t["k"]), F.lit("="), escaped(t["v"]))), ",")
    parts = ["c", "id", " k", "num_changes", " s", time("created_at"), " e", time("closed_at"), " d", "num_comments", " i", "uid", " u", escaped(F.col("user")), " x", side("min_lon_e7"), " y", side("min_lat_e7"), " X", side("max_lon_e7"), " Y", side("max_lat_e7"), " T", tags]
    text = [p if isinstance(p, Column) else F.col(p) if p in changesets.columns else F.lit(p) for p in parts]
    return changesets.select(F.concat(*text).alias("line"))

"""URL filters: rules first, then a tree of path templates for each host."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import materialise

#: (verdict, host, path) of the production rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Kinds of variable segments, by pattern; all else is a literal.
SHAPES = (
    ("<num>", r"^[0-9]+$"),
    ("<date>", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("<hex>", r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"),
    ("<num>.ext", r"^[0-9]+\.[a-z0-9]{1,5}$"),
    ("<slug>", r"^[^-]+(-[^-]+){3,}$"),
)
LITERAL, END = "<lit>", "<end>"
_KINDS = {f"kind{i}": s for i, s in enumerate([s for s, _ in SHAPES] + [LITERAL, END])}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case; path: from there to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits (null if none does).

    A rule fits its host and all subdomains if the path starts with the rule's.
    Length: of host and path together; ties: the longer host, then the first given.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1]), i))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in reversed(order):
        kind, name, start = rules[i]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SHAPES):
        found = F.when(segment.rlike(pattern), name).otherwise(found)
    return found


def _merge_siblings(near: float, purity_gap: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Greedy, largest first: a cell joins the first cluster that is like it in shape and purity."""
        pdf = pdf.sort_values(["n", "first"], ascending=[False, True])
        shapes = pdf[list(_KINDS)].to_numpy(float) / np.maximum(pdf["n"].to_numpy(float), 1)[:, None]
        purities = ((pdf["bad"] + pdf["prior"] * pdf["names"] * 4) / (pdf["bad"] + pdf["good"] + pdf["names"] * 4)).to_numpy(float)
        heads, cluster = [], np.zeros(len(pdf), dtype=np.int64)
        for i in range(len(pdf)):
            alike = (0.5 * np.abs(shapes[heads] - shapes[i]).sum(axis=1) <= near) & (np.abs(purities[heads] - purities[i]) <= purity_gap)
            if not alike.any():
                heads.append(i)
            cluster[i] = int(alike.argmax()) if alike.any() else len(heads) - 1
        return pdf[["host", "prefix", "cell"]].assign(cluster=cluster)

    return run


def _named_siblings(kids: DataFrame, host_prior: DataFrame, max_children: int, near: float, purity_gap: float) -> DataFrame:
    """(host, prefix, seg, new): what each literal child is called in templates, however many siblings it has.

    Children whose shape and purity fall into one cell of a grid so fine that any two of
    them pass the test are counted together first, so that Python sees cells, not children.
    """
    purity = (F.col("bad") + F.col("prior") * 4) / (F.col("bad") + F.col("good") + 4)
    grid = lambda x, step: F.round(x / step).cast("string") if step else x.cast("string")
    cell = F.concat_ws(",", *[grid(F.col(k) / F.col("n"), near / 4) for k in _KINDS], grid(purity, purity_gap / 4))
    kids = materialise(kids.join(host_prior, "host").withColumn("cell", cell), "url-kids")
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good", *_KINDS)]
    cells = kids.groupBy("host", "prefix", "cell").agg(F.count("*").alias("names"), F.min("seg").alias("first"), F.first("prior").alias("prior"), *sums)
    cells = materialise(cells, "url-cells")
    several = cells.groupBy("host", "prefix").agg(F.count("*").alias("c")).where("c > 1").select("host", "prefix")
    merged = cells.join(several, ["host", "prefix"], "left_semi").groupBy("host", "prefix").applyInPandas(_merge_siblings(near, purity_gap), "host string, prefix string, cell string, cluster long")
    placed = materialise(cells.join(merged, ["host", "prefix", "cell"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0))), "url-clusters")
    clusters = placed.groupBy("host", "prefix", "cluster").agg(F.sum("names").alias("names"), F.min("first").alias("first"), F.sum("n").alias("n"))
    wide = clusters.where(F.col("names") > max_children)
    # The largest of many names is *, any other is told apart by its first name.
    top = wide.groupBy("host", "prefix").agg(F.max(F.struct("n", (-F.col("cluster")).alias("c"))).alias("top"))
    wide = wide.join(top, ["host", "prefix"]).select("host", "prefix", "cluster", F.when(F.col("cluster") == -F.col("top.c"), "*").otherwise(F.concat(F.lit("{"), "first", F.lit("|*}"))).alias("many"))
    kids = kids.select("host", "prefix", "cell", "seg").join(placed.select("host", "prefix", "cell", "cluster"), ["host", "prefix", "cell"]).drop("cell")
    kids = kids.join(clusters.select("host", "prefix", "cluster", "names"), ["host", "prefix", "cluster"])
    few = kids.where(F.col("names").between(2, max_children)).groupBy("host", "prefix", "cluster").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("seg")), "|"), F.lit("}")).alias("few"))
    named = kids.join(wide, ["host", "prefix", "cluster"], "left").join(few, ["host", "prefix", "cluster"], "left")
    return materialise(named.select("host", "prefix", "seg", F.coalesce("many", "few").alias("new")).where("new is not null"), "url-names")


def path_templates(paths: DataFrame, max_depth: int = 4, max_children: int = 24, near: float = 0.25, purity_gap: float = 0.25) -> DataFrame:
    """Template of each distinct (host, path) with columns host, path, bad, good (labelled counts).

    Level by level from the root: segments of a variable kind become its wildcard; literal
    siblings, however many, merge if their next level has a similar spread of kinds (total
    variation up to ``near``) and their smoothed purity is within ``purity_gap``. Merged ones
    are called ``{a|b}``, more than ``max_children`` of them ``*`` (the largest such group of a
    node) or ``{a|*}``: that number only decides on the name. From ``max_depth``
    levels on, what lies under a prefix without labelled paths becomes ``**``: split up, all
    of it would have the purity of the host just the same. A prefix with labelled paths goes
    on as deep as it has several paths. Returns the input's columns and template.

    A node's children are counted by partial aggregation, so a host with any share of
    the pages is fine; cells of like children, not children, meet in one call of Python.
    """
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    rows = paths.withColumn("segs", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(parts)).withColumn("prefix", F.lit(""))
    host_prior = rows.groupBy("host").agg(((F.sum("bad") + 1.0) / (F.sum("bad") + F.sum("good") + 2.0)).alias("prior"))
    ended, depth = [], 0
    while True:
        if depth >= max_depth:
            left = F.size("segs") > depth
            ended.append(rows.where(~left).withColumn("template", F.col("prefix")))
            rows = rows.where(left)
            if rows.isEmpty():
                break
            nodes = rows.groupBy("host", "prefix").agg((F.sum("bad") + F.sum("good") > 0).alias("known"), (F.count("*") > 1).alias("many"))
            rows = materialise(rows.join(nodes, ["host", "prefix"]), "url-deep")
            rest = F.transform(F.slice("segs", depth + 1, F.size("segs")), lambda s: F.coalesce(_shape(s), s))
            closed = F.when(F.col("known"), F.concat("prefix", F.lit("/"), F.array_join(rest, "/"))).otherwise(F.concat("prefix", F.lit("/**")))
            open_ = F.col("known") & F.col("many")
            ended.append(rows.where(~open_).withColumn("template", closed).drop("known", "many"))
            rows = rows.where(open_).drop("known", "many")
            if rows.isEmpty():
                break
        raw, after = F.get("segs", F.lit(depth)), F.get("segs", F.lit(depth + 1))
        kind = _shape(raw)
        rows = rows.withColumn("lit", raw.isNotNull() & kind.isNull()).withColumn("seg", F.coalesce(kind, raw))
        next_kind = F.when(after.isNull(), END).otherwise(F.coalesce(_shape(after), F.lit(LITERAL)))
        kinds = [F.count_if(next_kind == k).alias(name) for name, k in _KINDS.items()]
        kids = rows.where("lit").groupBy("host", "prefix", "seg").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), *kinds)
        rows = rows.join(_named_siblings(kids, host_prior, max_children, near, purity_gap), ["host", "prefix", "seg"], "left")
        name = F.when(F.col("lit"), F.coalesce("new", "seg")).otherwise(F.col("seg"))
        rows = rows.withColumn("prefix", F.when(raw.isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), name)))
        rows = materialise(rows.drop("lit", "seg", "new"), "url-level")
        depth += 1
    named = ended[0]
    for more in ended[1:]:
        named = named.unionByName(more)
    return named.drop("segs", "prefix")


def judge_urls(pages: DataFrame, rules=RULES, reject_at: float = 0.7, smoothing: float = 4.0, id_col: str = "page_id", url_col: str = "url", label: Column | None = None, **tree) -> DataFrame:
    """Verdict for each url: the longest fitting rule's, else by the purity of its template.

    Labels (1: bad, 0: good, null: none): ``label``, by default the rules' own verdicts.
    Purity of a template: (bad + s * purity of the host) / (bad + good + s), the host's
    smoothed likewise towards that of all hosts; from ``reject_at`` on urls are blocked.

    Null urls and those without ``://`` have empty host and path and no rule. Every
    input row gives one row; repeated ids and urls are fine; other columns are ignored.
    Returns id, host, path, rule, verdict, template, purity.
    """
    host, path = host_and_path(F.col(url_col))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    given = F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0) if label is None else F.col("__label")
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), *([] if label is None else [label.cast("int").alias("__label")]))
    base = base.withColumns({"rule": rule, "said": said})
    base = base.withColumn("y", given).select("id", "host", "path", "rule", "said", "y")
    base = materialise(base, "url-base")
    distinct = base.groupBy("host", "path").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good"))
    named = path_templates(materialise(distinct, "url-paths"), **tree)
    every = named.agg(F.sum("bad"), F.sum("good")).first()
    overall = ((every[0] or 0) + 1.0) / ((every[0] or 0) + (every[1] or 0) + 2.0)
    known = F.sum("bad") + F.sum("good")
    hosts = named.groupBy("host").agg(((F.sum("bad") + smoothing * overall) / (known + smoothing)).alias("host_purity"))
    purity = (F.col("b") + smoothing * F.col("host_purity")) / (F.col("k") + smoothing)
    templates = named.groupBy("host", "template").agg(F.sum("bad").alias("b"), known.alias("k")).join(hosts, "host").select("host", "template", purity.alias("purity"))
    judged = named.select("host", "path", "template").join(templates, ["host", "template"])
    out = base.join(judged, ["host", "path"], "left")
    verdict = F.coalesce("said", F.when(F.col("purity") >= reject_at, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages judged by the production rules and the templates they label."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))

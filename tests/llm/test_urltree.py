import pytest
from pyspark.sql import functions as F

from waymill.llm.urltree import RULES, judge_urls


def brute(url):
    """host, path, rule and its verdict."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, None))
    return host, path, best[2], best[3]


URLS = [
    "https://Example.ORG/es/1", "http://www.example.org/en/12?x=/y", "https://example.org/en/2#f", "https://badexample.org/es/1", "http://a.com/fr/x", "http://a.com/de/x", "http://com/de/", "http://a.comx/de/", "http://a.org", "http://a.org?x", "http://ÄB.org/x",
    "a.org/x", "", None, "://", "http://", "http:///x/y", "x://y://z/w", "https://host.com:80/de/1", "HTTP://U@EXAMPLE.ORG/es/",
]


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)


def test_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(frame(spark, URLS)).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = brute(url)
        assert got[i][:3] == (host, path, rule), url
        assert got[i][3] == (verdict or got[i][3]) and got[i][3] in ("allow", "block")


def test_templates(spark):
    """Numbers, many literals and alike siblings become one; labels on a template judge its other urls."""
    urls = [f"http://h/shop/item/{i}" for i in range(30)] + [f"http://h/user/name{i}x/spam" for i in range(40)] + ["http://h/a/1/b", "http://h/c/2/b", "http://h/about"]
    df = frame(spark, urls)
    label = F.when(F.col("url").contains("spam") & (F.col("page_id") % 2 == 0), 1).when(F.col("url").contains("item"), 0)
    rows = {r.page_id: r for r in judge_urls(df, rules=(), label=label).collect()}
    assert {rows[i].template for i in range(30)} == {"/shop/item/<num>"}
    assert {rows[i].template for i in range(30, 70)} == {"/user/*/spam"}
    assert {rows[i].verdict for i in range(30)} == {"allow"} and {rows[i].verdict for i in range(30, 70)} == {"block"}
    assert rows[70].template == rows[71].template == "/{a|c}/<num>/b"
    assert rows[72].verdict == "allow" and rows[72].rule is None


def test_deep_and_repeated(spark):
    df = frame(spark, ["http://h/1/2/3/4/5/6/7"] * 3).withColumns({"host": F.lit("x"), "path": F.lit("y"), "seg": F.lit(1), "n": F.lit(2), "id": F.lit(3)})
    rows = judge_urls(df).collect()
    assert len(rows) == 3 and {r.template for r in rows} == {"/<num>/<num>/<num>/<num>/**"} and {r.host for r in rows} == {"h"}
    assert judge_urls(frame(spark, ["x"]).limit(0)).collect() == []


@pytest.mark.parametrize("smoothing", [0.5, 50.0])
def test_purity_is_smoothed(spark, smoothing):
    urls = ["http://h/bad/1"] * 3 + ["http://h/good/1"] * 20
    label = F.when(F.col("url").contains("bad"), 1).otherwise(0)
    rows = judge_urls(frame(spark, urls), rules=(), label=label, smoothing=smoothing).collect()
    verdicts = {r.verdict for r in rows if "bad" in r.path}
    assert verdicts == {"block" if smoothing < 1 else "allow"}


@pytest.mark.parametrize("n", [24, 25, 60])
def test_wide_nodes_keep_branches_apart(spark, n):
    """One blocked branch among many clean ones, and one clean among many blocked, whatever the fan-out."""
    for odd in (1, 0):
        urls = [f"http://h/part{b}x/page{p}y" for b in range(n) for p in range(12)]
        label = F.when(F.col("page_id") % 12 < 10, F.when(F.col("url").contains("/part3x/"), odd).otherwise(1 - odd))
        rows = judge_urls(frame(spark, urls), rules=(), label=label).collect()
        assert len(rows) == len(urls) and len({r.template for r in rows}) == 2
        for r in rows:
            assert (r.verdict == "block") == (("/part3x/" in r.path) == bool(odd)), r


def test_branches_differ_at_any_depth(spark):
    """Labels on deep branches judge their own branch only."""
    urls = [f"http://h/a/b/c/d/{x}/{i}" for x in ("spam", "news") for i in range(12)] + [f"http://h/a/b/c/d/e/f/g/{x}/{i}" for x in ("spam", "news") for i in range(12)]
    label = F.when(F.col("page_id") % 12 < 10, F.col("url").contains("spam").cast("int"))
    rows = judge_urls(frame(spark, urls), rules=(), label=label).collect()
    assert len(rows) == len(urls)
    assert all((r.verdict == "block") == ("spam" in r.path) for r in rows)


def plain_templates(paths, near=0.25, purity_gap=0.25, max_depth=4, max_children=24):
    """Templates of distinct (host, path) -> (bad, good), one tree and one node at a time."""
    import math
    import re

    from waymill.llm.urltree import END, LITERAL, SHAPES

    kinds = [k for k, _ in SHAPES] + [LITERAL, END]
    shape = lambda seg: next((k for k, pattern in SHAPES if re.search(pattern, seg)), None)
    half_up = lambda x: math.floor(x + 0.5)
    out = {}
    for host in {h for h, _ in paths}:
        own = {p: labels for (h, p), labels in paths.items() if h == host}
        prior = (sum(b for b, _ in own.values()) + 1) / (sum(b + g for b, g in own.values()) + 2)
        nodes, depth = {"": {p: ([] if p == "" else re.sub("^/", "", p).split("/")) for p in own}}, 0
        while nodes:
            below = {}
            for prefix, members in nodes.items():
                if depth >= max_depth:
                    for p in [p for p, segs in members.items() if len(segs) <= depth]:
                        out[host, p] = prefix
                        del members[p]
                    known = any(sum(own[p]) for p in members)
                    if not (known and len(members) > 1):
                        for p, segs in members.items():
                            out[host, p] = prefix + "/" + "/".join(shape(x) or x for x in segs[depth:]) if known else prefix + "/**"
                        continue
                kids = {}
                for p, segs in members.items():
                    if len(segs) > depth and shape(segs[depth]) is None:
                        kids.setdefault(segs[depth], []).append(p)
                stats = {}
                for seg, ps in kids.items():
                    nexts = [END if len(members[p]) <= depth + 1 else shape(members[p][depth + 1]) or LITERAL for p in ps]
                    bad, good = sum(own[p][0] for p in ps), sum(own[p][1] for p in ps)
                    shares = [nexts.count(k) / len(ps) for k in kinds]
                    purity = (bad + prior * 4) / (bad + good + 4)
                    cell = (*(half_up(x / (near / 4)) for x in shares), half_up(purity / (purity_gap / 4)))
                    stats.setdefault(cell, []).append((seg, len(ps), bad, good, [nexts.count(k) for k in kinds]))
                cells = [(sum(x[1] for x in xs), min(x[0] for x in xs), xs) for xs in stats.values()]
                clusters = []
                for n, _, xs in sorted(cells, key=lambda c: (-c[0], c[1])):
                    shares = [sum(x[4][k] for x in xs) / n for k in range(len(kinds))]
                    bad, good, names = sum(x[2] for x in xs), sum(x[3] for x in xs), len(xs)
                    purity = (bad + prior * names * 4) / (bad + good + names * 4)
                    for c in clusters:
                        if sum(abs(a - b) for a, b in zip(c["shares"], shares, strict=True)) / 2 <= near and abs(c["purity"] - purity) <= purity_gap:
                            c["segs"] += [x[0] for x in xs]
                            c["n"] += n
                            break
                    else:
                        clusters.append({"shares": shares, "purity": purity, "segs": [x[0] for x in xs], "n": n, "at": len(clusters)})
                wide = [c for c in clusters if len(c["segs"]) > max_children]
                top = max(wide, key=lambda c: (c["n"], -c["at"]), default=None)
                names = {}
                for c in clusters:
                    segs = sorted(c["segs"])
                    name = "*" if c is top else "{" + segs[0] + "|*}" if c in wide else "{" + "|".join(segs) + "}" if len(segs) > 1 else segs[0]
                    names |= dict.fromkeys(segs, name)
                for p, segs in members.items():
                    to = prefix if len(segs) <= depth else f"{prefix}/{shape(segs[depth]) or names[segs[depth]]}"
                    below.setdefault(to, {})[p] = segs
            nodes, depth = below, depth + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_templates_like_brute_force(spark, seed):
    from tests.llm.helpers import rng
    from waymill.llm.urltree import path_templates

    r = rng(seed)
    words = ["news", "shop", "spam", "user", "a-b", "tag", "about", "blog", *(f"w{i}x" for i in range(30))]
    paths = {}
    for _ in range(400):
        segs = [r.choice([r.choice(words), str(r.randrange(99)), "2024-01-02", "9f8e7d6c5b", f"{r.randrange(9)}.html", "a-b-c-d-e"][: 1 + r.randrange(6)]) for _ in range(r.randrange(8))]
        label = (1, 0) if "spam" in segs else (0, 1) if "news" in segs else (0, 0)
        paths[f"h{r.randrange(3)}", "/" + "/".join(segs) if segs else r.choice(["", "/", "//x"])] = label
    rows = [(h, p, b, g) for (h, p), (b, g) in paths.items()]
    got = {(x.host, x.path): x.template for x in path_templates(spark.createDataFrame(rows, "host string, path string, bad long, good long")).collect()}
    assert got == plain_templates(paths)


def test_very_long_urls(spark):
    """A path of many segments beside a short one, both labelled, a segment of a million characters, and an unlabelled one of many segments."""
    urls = ["http://h/" + "/".join(["x"] * 5000), "http://h/" + "y" * 1_000_000, "http://h/x", "http://g/" + "/".join(f"s{i}" for i in range(3000))]
    label = F.when(F.col("page_id") < 3, F.col("page_id") % 2)
    rows = {r.page_id: r for r in judge_urls(frame(spark, urls), rules=(), label=label.cast("int")).collect()}
    assert len(rows) == 4 and [len(rows[i].path) for i in range(4)] == [len(u) - 8 for u in urls] and rows[3].template.endswith("/**")

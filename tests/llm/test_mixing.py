from pyspark.sql import functions as F

from tests.llm.helpers import WORD, frame, rng, words
from waymill.llm.mixing import mix_sources, word_count


def mixed(df, **options):
    return mix_sources(df, word_count(F.col("text")), **options)


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Raise all levels together; who is full stops."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_ and left > 1e-6:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            room = epochs * sizes[s] - target[s]
            if share[s] >= room:
                target[s] += room
                left += share[s] - room
                open_.discard(s)
            else:
                target[s] += share[s]
    return target


def made(seed=1, n=300):
    r = rng(seed)
    return [(i, " ".join(words(r, r.randrange(0, 60) if i % 3 else 5)), "en", None if i % 17 == 0 else "s" + "abcde"[min(i % 3 + i % 2, 4)], 0) for i in range(n)]


def test_targets_and_shares(spark):
    df = spark.createDataFrame(made(), "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    rows = mixed(df).collect()
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        assert r.size == len(WORD.findall(next(t for i, t, *_ in made() if i == r.doc_id))) and 0 <= r.taken <= 3 * r.size
        assert r.taken % max(r.size, 1) == 0
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    target = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * target[r.source]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(largest.values()) * 2
    assert sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixed(df.repartition(7)).collect()), key=repr)  # reruns agree


def test_hot_source_in_many_ranges(spark):
    """Ranges don't show in the result, and no task that sums holds a whole source."""
    source = frame(spark, [(i, "a b c " * (i % 7)) for i in range(400)]).withColumn("source", F.lit("one"))
    whole = sorted(map(tuple, mixed(source).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert sorted(map(tuple, mixed(source).collect())) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges(spark):
    assert mixed(frame(spark, []).limit(0)).collect() == []
    texts = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (None, None)]
    df = frame(spark, texts).selectExpr("*", "1 AS id", "2 AS src", "3 AS size", "4 AS h", "5 AS taken")
    rows = mixed(df).collect()
    assert len(rows) == 6 and sorted(r.size for r in rows) == [0, 0, 0, 1, 2, 2]
    nothing = mixed(frame(spark, [(1, None), (2, " ")])).collect()
    assert [r.taken for r in nothing] == [0, 0]


def test_plan_is_native(spark):
    df = frame(spark, [(i, "a b") for i in range(5)])
    plan = mixed(df)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))

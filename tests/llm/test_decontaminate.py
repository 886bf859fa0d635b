import pytest

from tests.llm.helpers import frame, rng, words
from waymill.llm.decontaminate import ERROR_RATE, Pattern, drop_leaks, find_leaks, normalise


def least(item, text):
    """Least edit distance of the item to any stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        p = r.randrange(len(out))
        out[p : p + r.randrange(2)] = [r.choice("abcxyz")] * r.randrange(2)
    return "".join(out)


def made():
    r = rng(3)
    items = [(i, " ".join(words(r, 12, 3000))) for i in range(8)] + [(20, None), (21, ""), (22, "?!"), (23, "w1"), (5, "Second Row, same id."), (None, "item without an id here")]
    texts = []
    for i in range(60):
        item = items[i % 8][1]
        noise = edited(r, item, i // 8 * int(len(item) * ERROR_RATE) // 4)
        texts.append((i, " ".join(words(r, 10, 3000)) + ",\n" + noise.upper() + "! " + " ".join(words(r, 10, 3000))))
    texts += [(100, None), (101, ""), (102, "SECOND row same id"), (102, "SECOND row same id"), (None, "an Item without an ID here"), (103, "w" + "x " * 5000)]
    return texts, items


def test_like_brute_force(spark):
    texts, items = made()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in find_leaks(frame(spark, texts), bench).collect()}
    expected = set()
    for i, t in texts:
        plain = normalise(t)
        for j, x in items:
            item = normalise(x)
            if item and plain and (d := least(item, plain)) <= int(len(item) * ERROR_RATE):
                expected.add((i, j, d))
    assert got == expected and len(got) > 20
    kept = [r.doc_id for r in drop_leaks(frame(spark, texts), bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in texts if i not in {e[0] for e in expected})


def test_blocks_and_places(spark):
    texts, items = made()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, texts).selectExpr("*", "1 AS item_id", "2 AS id", "3 AS start")
    whole = {tuple(r) for r in find_leaks(df, bench).collect()}
    assert whole == {tuple(r) for r in find_leaks(df, bench, block_chars=100).collect()}
    by = dict(texts)
    for doc, item, distance, start, end in whole:
        if doc is not None and distance == 0:  # places are those of whole words
            assert any(normalise(x) in normalise(by[doc][start:end]) for i, x in items if i == item)


def test_empty(spark):
    bench = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert find_leaks(frame(spark, []).limit(0), bench).collect() == []
    assert find_leaks(frame(spark, [(1, "some words here")]), bench.limit(0)).collect() == []
    assert drop_leaks(frame(spark, [(1, "some words here")]), bench.limit(0)).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_bit_parallel_distance(seed):
    r = rng(seed)
    for _ in range(40):
        item = "".join(r.choice("abc ") for _ in range(r.randrange(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randrange(0, 120)))
        assert Pattern(item, 0.1).best(text)[0] == least(item, text)


@pytest.mark.parametrize("seed", range(3))
def test_some_piece_rises(seed):
    """An item within its budget has a piece that stands unchanged and whose parents are within theirs."""
    r = rng(seed)
    for _ in range(150):
        item = " ".join(words(r, 15, 50))
        budget = int(len(item) * ERROR_RATE)
        text = "".join(words(r, 3)) + edited(r, item, r.randrange(budget + 1)) + "".join(words(r, 3))
        pattern = Pattern(item, ERROR_RATE)
        if least(item, text) > budget:
            continue
        hits = [(p, at) for p in pattern.pieces for at in range(len(text)) if text.startswith(p.text, at)]
        assert any(p.rises(text, at) for p, at in hits)

import numpy as np
import pytest

from tests.llm.helpers import WORD, frame, rng, words
from waymill.llm.common import Words
from waymill.llm.minhash import connected, drop_near_duplicates, exact_keys, EXACT_SHINGLES, labelled_shingles, near_duplicates, ordered_similarity, sketch


def shingles(text, n=5):
    w = WORD.findall(text or "")
    runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
    seen, out = {}, []
    for x in runs:
        seen[x] = seen.get(x, 0) + 1
        out.append((x, seen[x]))
    return out


def similarity(a, b):
    """Longest common subsequence of shingles over all, by the plain table."""
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(row[j], best[j + 1]))
        best = row
    return best[-1] / (len(a) + len(b) - best[-1]) if a and b else 0


def brute(texts):
    ids = {i for i, _ in texts if i is not None}
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    known = [(i, shingles(t)) for i, t in texts if i is not None]
    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if similarity(a, b) >= 0.8:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def made():
    r = rng()
    texts = []
    for g in range(6):
        base = words(r, r.randrange(60, 150), 5000)
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(5)):
                p = r.randrange(len(copy))
                copy[p : p + r.randrange(2)] = [f"n{r.randrange(10**6)}"] * r.randrange(2)
            texts.append((len(texts) * 3 % 101, " ".join(copy)))
    half = words(r, 80, 5000)
    texts += [(200, " ".join(half)), (201, " ".join(half[40:] + half[:40])), (202, "one two"), (203, " one  two "), (204, "two one"), (205, None), (206, ""), (207, "a " * 50), (208, "a " * 49), (209, "a " * 20), (None, " ".join(half))]
    return texts


def test_like_brute_force(spark):
    texts = made()
    got = near_duplicates(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.group for r in got if r.doc_id is not None} == brute(texts)
    assert [r.group for r in got if r.doc_id is None] == [None]


def test_one_of_a_group_stays(spark):
    texts = made()
    kept = drop_near_duplicates(frame(spark, texts).selectExpr("*", "1 AS id", "2 AS group", "3 AS label"))
    labels = brute(texts)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(labels.values()))
    assert kept.where("doc_id is null").count() == 1 and kept.columns[-1] == "label"
    assert near_duplicates(frame(spark, []).limit(0)).collect() == []


def test_large_groups(spark, monkeypatch):
    """Copies of a base that are nearer to it than to each other, beyond one block, and one whose words all repeat."""
    from waymill.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    r = rng(5)
    base = words(r, 120, 9000)
    texts = [(1000, " ".join(base))]
    for i in range(70):
        copy = list(base)
        for _ in range(1 + i % 4):
            copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
        texts.append((i, " ".join(copy)))
    got = {x.doc_id: x.group for x in near_duplicates(frame(spark, texts)).collect()}
    assert got == brute(texts)


def test_components(spark):
    links = [(i + 1, i) for i in range(20)] + [(40, 30), (50, 40), (60, 70)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 40: 30, 50: 30, 60: 60, 70: 60}


@pytest.mark.parametrize("seed", range(5))
def test_alignment(seed):
    r = rng(seed)
    a = words(r, 50, 30 + 400 * (seed % 2))
    b = a[: r.randrange(50)] + words(r, 3, 30) + a[r.randrange(40) :]
    found = [labelled_shingles(Words([" ".join(t)]))[0] for t in (a, b)]
    exact = similarity(shingles(" ".join(a)), shingles(" ".join(b)))
    assert ordered_similarity(*found) == (pytest.approx(exact) if exact >= 0.8 else 0)
    assert ordered_similarity(*found, least=0.01) == pytest.approx(exact)


def test_sketches_agree_as_often_as_promised():
    """At similarity 0.8 the ORDERED least shingles are common in about 0.8 ** ORDERED of sketches."""
    r = np.random.default_rng(0)
    same = []
    for _ in range(60):
        x = r.integers(1, 1 << 63, 450).astype(np.uint64)
        same.append((sketch(x[:405]) == sketch(x[45:])).mean())  # 360 of 450
    assert 0.35 < np.mean(same) < 0.47


def test_short_texts_meet_by_exact_keys(spark):
    """Pairs at the threshold: 8 words and one more, 4 of 5 shingles, of which equal sketches miss one in a hundred."""
    r = rng(21)
    texts = []
    for p in range(1500):
        words = [f"x{r.randrange(10**6)}" for _ in range(8)]
        texts += [(2 * p, " ".join(words)), (2 * p + 1, " ".join([*words, "more"]))]
    got = {row.doc_id: row.group for row in near_duplicates(frame(spark, texts)).collect()}
    assert [i for i, g in got.items() if g != i - i % 2] == []


def test_exact_keys_are_shared():
    r = np.random.default_rng(5)
    for _ in range(500):
        a = r.integers(1, 2**63, int(r.integers(1, EXACT_SHINGLES + 1))).astype(np.uint64)
        gone = int(r.integers(0, len(a)))
        b = np.r_[a[gone:], r.integers(1, 2**63, int(r.integers(0, 4))).astype(np.uint64)]
        if len(a) - gone >= 0.8 * (len(b) + gone) and len(b) <= EXACT_SHINGLES:
            assert np.isin(exact_keys(a), exact_keys(b)).any()


def test_words_that_defeat_powers_modulo_two_to_the_64th(spark):
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    texts = [(1, thue), (2, thue.translate(str.maketrans("ab", "ba"))), (3, thue)]
    assert {r.doc_id: r.group for r in near_duplicates(frame(spark, texts)).collect()} == {1: 1, 2: 2, 3: 1}


def test_recall_on_the_tables(spark):
    """All pairs of the documents table that brute force aligns at 0.8 are in one group, and nothing else is."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    found, bounds = labelled_shingles(Words([r.text for r in rows]))
    own = [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    holders = {}
    for i, mine in enumerate(own):
        for x in mine.tolist():
            holders.setdefault(x, []).append(i)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = 0
    for i, mine in enumerate(own):
        shared = {}
        for x in mine.tolist():
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, c in shared.items():
            if c >= 0.8 * (len(mine) + len(own[j]) - c) - 1e-9 and ordered_similarity(mine, own[j]) > 0:
                links += 1
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    got = {r.doc_id: r.group for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert links > 20 and got == {r.doc_id: least[find(i)] for i, r in enumerate(rows)}

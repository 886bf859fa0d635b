"""Language identification and toxicity: known formulas and held-out accuracy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, rng
from waymill.llm import langid, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["üs", "ör", "rk", "äl"], "cc": ["zia", "que", "ñor", "illo"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def samples(seed, n=60):
    r = rng(seed)
    return {lang: [prose(r, lang, 40) for _ in range(n)] for lang in SYLLABLES}


def test_probabilities_sum_to_one():
    """Of the characters that any language has seen, plus what is left for unseen ones."""
    model = langid.fit_models({"aa": ["ab abc abd abab"] * 3}, order=3)
    letters = sorted(set("abcd "))
    for context in ("a", "ab", "abd"):
        total = 0.0
        for c in letters:
            total += 2.0 ** -(own_bits(model, context + c) - (own_bits(model, context) if context else 0))
        assert 0.9 < total < 1.02


def own_bits(model, text):
    """Bits of the whole of a text that stands within a word."""
    bits, _ = model.entropies([text])
    codes, _, _ = langid.encode([text])
    return bits[0, 0] * (len(codes) - 1)


def test_kneser_ney_by_hand():
    """Bigrams with the interpolated formula, worked out in full."""
    text = ["abab ab"]
    model = langid.fit_models({"aa": text}, order=2)
    seq = " abab ab"  # one space leads, none is added behind
    pairs = [seq[i : i + 2] for i in range(len(seq) - 1)]
    kinds = sorted(set(pairs))
    before = {c: len({p[0] for p in kinds if p[1] == c}) for c in set(seq)}
    n1, n2 = (sum(pairs.count(p) == k for p in kinds) for k in (1, 2))
    d2 = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
    m1, m2 = (sum(v == k for v in before.values()) for k in (1, 2))
    d1 = min(max(m1 / max(m1 + 2 * m2, 1), 0.1), 0.9)
    total = sum(before.values())
    low = {c: max(v - d1, 0) / total + d1 * len(before) / total / len(before) for c, v in before.items()}
    for p in kinds:
        c = sum(pairs.count(q) for q in kinds if q[0] == p[0])
        expected = max(pairs.count(p) - d2, 0) / c + d2 * sum(q[0] == p[0] for q in kinds) / c * low[p[1]]
        codes = np.array([ord(x) for x in p], dtype=np.uint32)
        key = langid.gram_keys(codes, np.zeros(2, int), 2)[1][1:]
        place = model.tables[1].find(key)[0]
        assert 2.0 ** float(model.logp[1][place, 0]) == pytest.approx(expected, rel=1e-4)


def test_held_out_accuracy():
    model = langid.fit_models(samples(1))
    for lang, texts in samples(2).items():
        said, score, _, accepted = model.judge(texts + [t[:6] for t in texts])
        assert np.mean([s == lang for s in said]) > 0.97 and score[:60].min() > 0.9 and accepted[:60].mean() > 0.98
    _, _, _, accepted = model.judge(["xyzzy wqpf jhgg vvvv " * 10, "漢字仮名交じり文" * 10])
    assert not accepted.any()


def test_documents(spark):
    data = samples(1, 30)
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in data for t in data[lang])]
    rows += [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None), (None, data["aa"][0], None), (903, data["aa"][1], None), (903, data["aa"][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "bits": F.lit(2), "lang_pred": F.lit("x")})
    model = langid.train_on_documents(df)
    got = {r.doc_id: r for r in langid.identify(df.drop("score"), model).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0 and not got[901].accepted
    assert got[903].lang_pred == got[None].lang_pred == "aa"
    kept = langid.drop_rejected(df, model)
    assert kept.columns == df.columns and kept.where("doc_id in (900, 901, 902)").isEmpty() and kept.where("doc_id = 903").count() == 2
    assert langid.identify(df.limit(0), model).collect() == []
    nothing = langid.train_on_documents(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}


def toxic_texts(seed, n):
    """Neither word alone is a verdict; both together are."""
    r = rng(seed)
    out = []
    for i in range(n):
        words = [r.choice("the of and in on to is as at by".split()) for _ in range(30)]
        kind = i % 4
        if kind & 1:
            words[3] = r.choice(["zorp", "zorps", "zorpish"])
        if kind & 2:
            words[9] = r.choice(["blarg", "blargs"])
        out.append((" ".join(words), int(kind == 3)))
    return out


def test_pairs_are_learned():
    make = toxicity.Featuriser()
    train, test = toxic_texts(1, 2000), toxic_texts(2, 800)
    model = toxicity.FactorizationMachine().fit([make(t) for t, _ in train], np.array([y for _, y in train]))
    column = toxicity.Featuriser(model.columns)
    p = model.predict([column(t) for t, _ in test])
    y = np.array([label for _, label in test])
    assert p[y == 1].min() > 0.7 and p[y == 0].max() < 0.3
    x = model.v
    sets = column(test[3][0])
    by_hand = model.bias + model.w[sets].sum() + sum(x[a] @ x[b] for n, a in enumerate(sets) for b in sets[:n])
    assert 1 / (1 + math.exp(-by_hand)) == pytest.approx(p[3])


def test_labels_that_only_a_pair_tells():
    """Label 1: both words or neither; each word alone is as often in either."""
    r = rng(8)
    data = []
    for i in range(2400):
        fill = [f"f{r.randrange(300)}" for _ in range(12)]
        both = (["zorp"] if i % 2 else []) + (["blarg"] if i // 2 % 2 else [])
        data.append((" ".join(fill + both), int(len(both) != 1)))
    make = toxicity.Featuriser()
    model = toxicity.FactorizationMachine().fit([make(t) for t, _ in data[:1600]], np.array([y for _, y in data[:1600]]))
    column = toxicity.Featuriser(model.columns)
    p = model.predict([column(t) for t, _ in data[1600:]])
    assert np.mean([(q > 0.5) == y for q, (_, y) in zip(p, data[1600:], strict=True)]) > 0.99


def test_pairs_by_brute_force():
    """pair_columns against a plain count of all pairs."""
    r = np.random.default_rng(2)
    rows = [np.sort(r.choice(40, int(r.integers(5, 15)), replace=False)).astype(np.int32) for _ in range(600)]
    y = np.array([float((3 in set(x.tolist())) == (17 in set(x.tolist()))) for x in rows])
    gap = y - y.mean()
    n = sum(sum(i in set(x.tolist()) for x in rows) >= 20 for i in range(40))
    least = np.sqrt(2 * np.log(n**2 / 2 / 0.05))
    plain = set()
    for i in range(40):
        for j in range(i):
            g = np.array([d for x, d in zip(rows, gap, strict=True) if i in x and j in x])
            if len(g) and abs(g.sum()) >= least * np.sqrt((g**2).sum()):
                plain |= {i, j}
    assert {3, 17} <= plain and set(toxicity.pair_columns(rows, gap, np.zeros(0, int)).tolist()) == plain
    assert set(toxicity.pair_columns(rows, gap, np.array([3])).tolist()) == plain - {3}
    assert len(toxicity.pair_columns(rows, gap, np.array(sorted(plain)))) == 0


def test_repeated_and_contradictory_labels(spark):
    texts = [(i, "the zorp" if i % 2 else "the word") for i in range(400)]
    docs = frame(spark, texts + texts[:50])
    labels = [(i, i % 2, 0, "zorp") for i in range(400)] * 2 + [(i, 1 - i % 2, 0, "x") for i in range(20)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int, n_chars int, text string")
    model = toxicity.fit_toxicity(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert min(scores[i] for i in scores if i % 2) > 0.7 and max(scores[i] for i in scores if not i % 2) < 0.3
    assert len({round(scores[i], 12) for i in scores if i % 2}) == 1  # ties score alike
    empty = docs.limit(0)
    model = toxicity.fit_toxicity(empty, labels)
    assert toxicity.score_toxicity(empty, model).collect() == [] and 0 <= toxicity.score_toxicity(docs, model).first().score <= 1


def test_toxicity_of_documents(spark, tmp_path):
    data = toxic_texts(4, 1200)
    texts = [(i, t) for i, (t, _) in enumerate(data)] + [(5000, None), (5001, ""), (None, "zorp blarg"), (7, "zorp blarg")]
    frame(spark, texts).selectExpr("*", "1 AS score", "2 AS y").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, y) for i, (_, y) in enumerate(data)] + [(None, 1, 1), (9999, 1, 1), (3, 0, None), (2, 0, 5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, data[r.doc_id][1]) for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1200 and r.doc_id != 7]
    assert len(held) > 300 and np.mean([a == b for a, b in held]) > 0.99
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


def test_languages_of_few_long_texts_are_learned(spark):
    """Texts far longer than the sample, and many rows of one id: every language is in it, within its bound."""
    r = rng(9)
    texts = [(i, prose(r, "aa", 40), "aa") for i in range(300)] + [(1000 + i, prose(r, "bb", 9000), "bb") for i in range(3)] + [(77, prose(r, "cc", 40), "cc")] * 400
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = langid.sample_texts(docs, train_chars=3000)
    assert set(got) == {"aa", "bb", "cc"}
    assert len(got["bb"]) == 3 and 900 <= sum(map(len, got["bb"])) <= 1000
    assert set(langid.sample_texts(docs.where("lang = 'bb'"), train_chars=1)) == {"bb"}
    assert langid._even_cap([5, 100, 100], 105) == 50 and langid._even_cap([3, 4], 100) >= 4


def test_scores_do_not_depend_on_the_sample(spark):
    """Scores average to the share of toxic labels, whether or not the bound evens out the sample."""
    texts = [(i, "the word zorp" if (i // 10) % 2 == 0 and i % 10 == 0 or i % 6 == 1 and i % 10 else "the word other") for i in range(6000)]
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(6000)], "doc_id long, toxic int")
    means = []
    for bound in (6000, 500):
        scores = [r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, train_rows=bound)).collect()]
        means.append(np.mean(scores))
    assert abs(means[0] - 0.1) < 0.02 and abs(means[1] - 0.1) < 0.03


def plain_models(samples, order=4):
    """Interpolated Kneser-Ney as it is written in books, with dictionaries: (language, text) -> bits for each character."""
    coded = {lang: ["".join(map(chr, langid.encode([t])[0].tolist())) for t in texts] for lang, texts in samples.items()}
    counts = {lang: [{} for _ in range(order + 1)] for lang in coded}
    for lang, texts in coded.items():
        for t in texts:
            for i in range(len(t)):
                for n in range(1, min(order, i + 1) + 1):
                    if n > 1 or i:
                        gram = t[i - n + 1 : i + 1]
                        counts[lang][n][gram] = counts[lang][n].get(gram, 0) + 1
        for n in range(order - 1, 0, -1):  # below the top: by how many characters it is led
            seen = set(counts[lang][n + 1])
            for gram in counts[lang][n]:
                counts[lang][n][gram] = max(1, sum(longer[1:] == gram for longer in seen))
    vocabulary = max(2, len({g for lang in coded for g in counts[lang][1]}))
    least = 1 / (vocabulary * 64)
    every = [set().union(*[counts[lang][n] for lang in coded]) for n in range(order + 1)]
    contexts = [{g[:-1] for g in grams} for grams in every]

    def parts(lang, n, context):
        own = counts[lang][n]
        ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        discount = min(0.9, max(0.1, ones / max(ones + 2 * twos, 1)))
        inside = [c for g, c in own.items() if g[:-1] == context]
        total = sum(inside)
        return discount, total, discount * len(inside) / total if total else 1.0

    def p(lang, gram):
        n = len(gram)
        if gram not in every[n]:
            return None
        discount, total, free = parts(lang, n, gram[:-1])
        share = max(counts[lang][n].get(gram, 0) - discount, 0) / total if total else 0.0
        below = 1 / vocabulary if n == 1 else (p(lang, gram[1:]) or least)
        return max(share + free * below, least)

    def bits(lang, text):
        t = "".join(map(chr, langid.encode([text])[0].tolist()))
        total = 0.0
        for i in range(1, len(t)):
            for n in range(order, 0, -1):
                gram = t[i - n + 1 : i + 1] if i + 1 >= n else None
                found = p(lang, gram) if gram is not None else None
                if found is not None:
                    total -= math.log2(found)
                    break
                context = t[i - n + 1 : i] if i + 1 >= n else None
                if n > 1 and context in contexts[n]:
                    total -= math.log2(parts(lang, n, context)[2])
            else:
                total -= math.log2(least)
        return total / max(len(t) - 1, 1)

    return bits


def test_entropies_like_brute_force():
    samples = {"aa": ["kamilo sona, la", "ka ka 12 mira", "sol"], "bb": ["und der kam", "die kamile", "ob x"]}
    model, bits = langid.fit_models(samples), plain_models(samples)
    texts = ["kamilo", "der und", "la sol ñandu", "x", "mir die ka 7 sona", "KA LA", "", "12 !"]
    got, letters = model.entropies(texts)
    for text, row, n in zip(texts, got, letters, strict=True):
        if n:
            assert row == pytest.approx([bits("aa", text), bits("bb", text)], abs=1e-4), text

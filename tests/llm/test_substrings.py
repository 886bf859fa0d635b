import hashlib

import numpy as np
import pytest

from tests.llm.helpers import WORD, frame, rng, words
from waymill.llm.common import Words
from waymill.llm.substrings import drop_repeats, merge, rename, repeats_by_symbols, word_symbols


def brute(texts, n=13):
    """kept words and count of words by row, in the order of the texts."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in texts:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            run = tuple(w[k : k + n])
            first[run] = min(first.get(run, float("inf")), key(i))
    out = []
    for i, t in texts:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < key(i):
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def made():
    r = rng()
    passage, long = words(r, 60), words(r, 3000)
    texts = [(1, " ".join(long)), (2, " ".join(words(r, 30) + passage + words(r, 30))), (3, " ".join(passage)), (4, " ".join(long[100:400] + passage[5:25]))]
    texts += [(5, "the " * 40), (6, "x " + "the " * 14 + "y"), (7, "a b " * 30), (8, "z a b " + "a b " * 9), (9, None), (10, ""), (11, " \t\n"), (12, "short one")]
    texts += [(3, " ".join(passage)), (None, " ".join(passage)), (None, " ".join(passage)), (13, " ".join(passage)), (14, "ü\t" + "\n".join(passage[:13]))]
    return texts


def test_like_brute_force(spark):
    texts = made()
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in drop_repeats(frame(spark, texts)).collect()]
    assert sorted(got, key=repr) == brute(texts)


def test_spans_and_other_columns(spark):
    texts = [(1, " ".join(f"a{i}" for i in range(20))), (2, "x " + " ".join(f"a{i}" for i in range(20)) + " y")]
    df = frame(spark, texts).selectExpr("*", "1 AS chunk", "2 AS answers", "3 AS n_words")
    by = {r.doc_id: r for r in drop_repeats(df).collect()}
    assert by[1].spans == [] and [tuple(s) for s in by[2].spans] == [(1, 21)] and by[2].text == "x y"
    assert drop_repeats(frame(spark, []).limit(0)).collect() == []


def symbols_of(texts, rounds, shared=lambda docs: True):
    """Levels of symbols, named by a dictionary; ``shared`` says by the texts that have a symbol whether it gets a name."""
    found = Words(texts)
    names = {w: i + 1 for i, w in enumerate(found.distinct)}
    seen = {}
    for i, d in zip(found.index.tolist(), found.doc.tolist(), strict=True):
        seen.setdefault(i, set()).add(d)
    first = np.array([names[found.distinct[i]] if shared(seen[i]) else 0 for i in found.index.tolist()], dtype=np.int64)
    levels, number = [word_symbols(first, found.doc)], len(names) + 1
    for k in range(rounds):
        m = merge(levels[-1], 77 * (k + 1), k == 0)
        docs = {}
        for at, place in zip(m.fresh.tolist(), m.place.tolist(), strict=True):
            docs.setdefault(place, set()).add(int(m.symbols.doc[at]))
        levels.append(rename(m, np.array([number + i if shared(docs[i]) else 0 for i in range(len(m.keys))], dtype=np.int64)))
        number += len(m.keys)
    return found, levels


def spelled(found, levels, level):
    """The words of each symbol of a level."""
    w = [found.distinct[i] for i in found.index.tolist()]
    s = levels[level]
    return [(int(n), tuple(w[a:b])) for n, a, b in zip(s.name, s.start, s.end, strict=True)]


def test_names_spell_the_same_words_and_windows_the_same_symbols():
    r = rng(3)
    common = words(r, 40)
    texts = [" ".join(words(r, r.randrange(20)) + common + words(r, r.randrange(20))) for _ in range(30)] + ["a a a b " * 20, "b a a a b a a a " * 9, "a " * 50, ""]
    found, levels = symbols_of(texts, 4)
    for level in range(5):
        by = {}
        for name, run in spelled(found, levels, level):
            by.setdefault(name, set()).add(run)
        assert all(len(runs) == 1 for runs in by.values())
    assert len(levels[4].name) < 0.5 * len(found)
    at, key, check = repeats_by_symbols(levels, found.hashes, 13)
    w = [found.distinct[i] for i in found.index.tolist()]
    by = {}
    for i, k, c in zip(at.tolist(), key.tolist(), check.tolist(), strict=True):
        by.setdefault(tuple(w[i : i + 13]), set()).add((k, c))
    assert all(len(keys) == 1 for keys in by.values()) and len({k for keys in by.values() for k in keys}) == len(by)
    assert sum(len(t.split()) >= 13 and len(t.split()) - 12 for t in texts) == len(at)


def test_symbols_of_one_text_end_windows_that_stand_nowhere_else():
    r = rng(5)
    common = words(r, 20, 30)
    texts = [" ".join(words(r, 30, 30) + common + words(r, 30, 30)) for _ in range(6)]
    found, levels = symbols_of(texts, 3, lambda docs: len(docs) > 1)
    at, _, _ = repeats_by_symbols(levels, found.hashes, 13)
    w = [found.distinct[i] for i in found.index.tolist()]
    docs = {}
    for i in range(len(w) - 12):
        if found.doc[i] == found.doc[i + 12]:
            docs.setdefault(tuple(w[i : i + 13]), set()).add(int(found.doc[i]))
    repeated = {i for i in range(len(w) - 12) if found.doc[i] == found.doc[i + 12] and len(docs[tuple(w[i : i + 13])]) > 1}
    assert repeated <= set(at.tolist()) and len(at) < len(w) / 2


def test_words_that_defeat_powers_modulo_two_to_the_64th(spark):
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"v{i}" for i in range(12))
    texts = [(1, f"{same} {thue}"), (2, f"{same} {other}"), (3, f"{same} {other}")]
    assert [(r.doc_id, r.n_removed) for r in drop_repeats(frame(spark, texts)).orderBy("doc_id").collect()] == [(1, 0), (2, 0), (3, 13)]


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_any_number_of_rounds_and_chunks_of_any_size(spark, rounds):
    texts = made()
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in drop_repeats(frame(spark, texts), rounds=rounds, chunk_bytes=500).collect()]
    assert sorted(got, key=repr) == brute(texts)


def test_digest(spark, tmp_path):
    from waymill.llm.substrings import op7_substrings

    texts = made()[:8]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_removed, r.kept_sha256) for r in op7_substrings(spark, str(tmp_path)).collect()}
    assert got == {(i, g, hashlib.sha256(t.encode()).hexdigest()) for i, _, g, t in brute(texts)}


@pytest.mark.parametrize("window", [3, 5])
def test_other_windows(spark, window):
    r = rng(7)
    texts = [(i, " ".join(words(r, 60, 12))) for i in range(12)]
    got = [(x.doc_id, x.n_words, x.n_removed, x.text) for x in drop_repeats(frame(spark, texts), window).collect()]
    assert sorted(got, key=repr) == brute(texts, window)

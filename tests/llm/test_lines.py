import pytest

from tests.llm.helpers import frame, rng
from waymill.llm.lines import drop_line_copies, drop_repeated_lines, neighbourhood, piece_keys

BLANK = " \t\r\v\f"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(texts):
    key = lambda i: float("inf") if i is None else i
    every = [(key(i), n, line) for i, t in texts for n, line in enumerate((t or "").split("\n")) if line.strip(BLANK)]
    out = []
    for i, t in texts:
        kept = []
        for n, line in enumerate((t or "").split("\n")):
            here = (key(i), n)
            gone = line.strip(BLANK) and any((a, b) < here and (x == line or near(x, line)) for a, b, x in every)
            if not gone:
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def made():
    r = rng()
    base = ["".join(r.choice("abcdeéß ") for _ in range(r.randrange(15, 60))) for _ in range(12)]
    texts = [(0, "\n".join(base))]
    for i in range(1, 40):
        line = r.choice(base)
        p = r.randrange(len(line))
        edited = [line[:p] + "ö" + line[p + 1 :], line[:p] + line[p + 1 :], line[:p] + "x" + line[p:], line, line[:p] + "yz" + line[p:], line[: len(line) // 2]][i % 6]
        texts.append((i, "\n".join([edited, "", " ", f"own line number {i} of this text here"])))
    same = "a" * 30
    texts += [(50, same), (51, same + "a"), (52, same[1:] + "b"), (53, "b" + same[1:]), (54, None), (55, ""), (56, "\n\n"), (57, "short"), (58, "shork"), (59, "short"), (59, "short"), (None, "short"), (None, "only here, without a number")]
    texts += [(60 + i, x) for i, x in enumerate(["q", "Q", "12", "1", "one", "tone", "ton", "n" * 19, "n" * 18, "n" * 20, "é", "éé", "x" * 3000, "x" * 1500 + "y" + "x" * 1499])]
    return texts


def test_like_brute_force(spark):
    texts = made()
    out = drop_repeated_lines(frame(spark, texts))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == brute(texts)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 19, 20, 21, 37])
def test_neighbours_meet(size):
    """Each line one edit away shares a piece, and in it a variant."""
    r = rng(size)
    line = "".join(r.choice("ab") for _ in range(size))
    pieces = piece_keys(line)
    for p in range(size + 1):
        for other in {line[:p] + "a" + line[p:], line[:p] + "b" + line[p + 1 :], line[:p] + line[p + 1 :]} - {line}:
            theirs = piece_keys(other)
            mine = [j for j, k in enumerate(pieces) if k in theirs]
            also = [j for j, k in enumerate(theirs) if k in pieces]
            assert mine and also
            a, b = set(neighbourhood(line, mine)), set(neighbourhood(other, also))
            meet = {k for k, kind in a if kind == 0} & {k for k, kind in b if kind == 0}
            meet |= {k for k, kind in a if kind == 1} & {k for k, kind in b if kind == 2}
            meet |= {k for k, kind in a if kind == 2} & {k for k, kind in b if kind == 1}
            assert meet


def test_documents_of_copies_go(spark):
    texts = [(1, "one line\nanother line"), (2, "another line\none line"), (3, "one line\nnew line"), (4, ""), (5, None)]
    out = drop_line_copies(frame(spark, texts).selectExpr("*", "7 AS hash", "8 AS near"))
    assert sorted((r.doc_id, r.text) for r in out.where("doc_id < 5").collect()) == [(1, "one line\nanother line"), (3, "new line"), (4, "")]
    assert out.where("doc_id = 5").count() == 1 and "near" in out.columns
    assert drop_repeated_lines(frame(spark, []).limit(0)).collect() == []

"""Benchmark decontamination: pigeonhole pieces found exactly, verified by Myers' bit-parallel distance."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import tidied

#: Share of an item's characters that may differ.
ERROR_RATE = 0.1
#: Characters of items that are sent to the executors at once.
BLOCK_CHARS = 4_000_000
_TOKEN = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    """Lower-case words joined by one space."""
    return " ".join(_TOKEN.findall(text or "")).lower()


class Pattern:
    """A test item or a part of it: its error budget, and Myers' masks.

    An item of budget k is a tree with k + 1 pieces as leaves. Where a part with e
    errors at most splits into parts of budgets e1 + e2 = e - 1, one of the two keeps
    to its own budget; so some piece stands unchanged and each part above it, up to the
    item, is within budget. A piece that is found is followed upwards until a part isn't.
    """

    def __init__(self, text: str, rate: float):
        budget = int(len(text) * rate)
        cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
        self.pieces: list[Pattern] = []
        self._set(text, 0, budget, None)
        self._split(text, cuts, self.pieces)

    def _set(self, text: str, offset: int, budget: int, above: "Pattern | None"):
        self.text, self.size, self.offset, self.budget, self.above, self.other = text, len(text), offset, budget, above, None

    def _split(self, text: str, cuts: list[int], pieces: "list[Pattern]"):
        if len(cuts) == 2:
            pieces.append(self)
            return
        half = len(cuts) // 2
        kids = []
        for part in (cuts[: half + 1], cuts[half:]):
            kid = Pattern.__new__(Pattern)
            kid._set(text[part[0] : part[-1]], part[0], len(part) - 2, self)
            kid._split(text, part, pieces)
            kids.append(kid)
        if len(cuts) == 3:
            kids[0].other, kids[1].other = kids[1], kids[0]

    def near(self, plain: str, at: int) -> bool:
        """Whether the other of two sibling pieces may stand beside this one, at ``at``, with one error."""
        text = self.other.text
        half = len(text) // 2
        if self.other.offset > self.offset:
            at += self.size
            return plain.startswith(text[:half], at) or plain.find(text[half:], at + half - 1, at + len(text) + 1) >= 0
        at -= len(text)
        return plain.startswith(text[half:], max(0, at + half)) or plain.find(text[:half], max(0, at - 1), at + half + 1) >= 0

    def rises(self, plain: str, at: int) -> bool:
        """Whether all parts above this piece, found at ``at``, are within their budgets there (the item itself untested)."""
        if self.other is not None and not self.near(plain, at):
            return False
        part = self.above
        while part is not None and part.above is not None:
            start = at - self.offset + part.offset
            if part.best(plain[max(0, start - part.budget) : start + part.size + part.budget])[0] > part.budget:
                return False
            part = part.above
        return True

    def masks(self, backwards: bool = False) -> dict[str, int]:
        name = "_back" if backwards else "_on"
        if not hasattr(self, name):
            found: dict[str, int] = {}
            for i, c in enumerate(reversed(self.text) if backwards else self.text):
                found[c] = found.get(c, 0) | 1 << i
            setattr(self, name, found)
        return getattr(self, name)

    def best(self, text: Iterable[str], backwards: bool = False, anchored: bool = False) -> tuple[int, int]:
        """Least distance of the item to a stretch of text and the first place where a best one ends.

        anchored: the stretch must begin where the text does.
        """
        masks = self.masks(backwards)
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        least, at = self.size, 0
        carry = 1 if anchored else 0
        for i, c in enumerate(text):
            eq = masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | carry) & full
            mh = (mh << 1) & full
            plus = mh | (full & ~(xv | ph))
            minus = ph & xv
            if score < least:
                least, at = score, i + 1
        return least, at


class Matcher:
    """Finds items within their error budgets in whole texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, Pattern(t, rate)) for i, t in items]
        where: dict[str, list[tuple[int, Pattern]]] = {}
        for n, (_, pattern) in enumerate(self.items):
            for piece in pattern.pieces:
                where.setdefault(piece.text, []).append((n, piece))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best match of each item; bounds are code points of text.

        first: stop at the first match.
        """
        if not self.items or not text:
            return []
        plain = normalise(text)
        stretches: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(plain):
            for n, piece in places:
                start = end + 1 - size
                if not piece.rises(plain, start):
                    continue
                pattern = self.items[n][1]
                a = max(0, start - piece.offset - pattern.budget)
                b = min(len(plain), start - piece.offset + pattern.size + pattern.budget)
                known = stretches.setdefault(n, [])
                if known and a <= known[-1][1] and known[-1][0] <= b:
                    known[-1] = [min(a, known[-1][0]), max(b, known[-1][1])]
                else:
                    known.append([a, b])
        found = []
        for n, known in stretches.items():
            item, pattern = self.items[n]
            least, span = pattern.budget + 1, (0, 0)
            for a, b in known:
                distance, size = pattern.best(plain[a:b])
                if distance < least:
                    least, span = distance, (a, a + size)
                    if distance == 0 or first:
                        break
            if least <= pattern.budget:
                if first:
                    return [(item, least, 0, 0)]
                a, b = span
                _, back = pattern.best(reversed(plain[a:b]), backwards=True, anchored=True)
                words = list(_TOKEN.finditer(text))
                i, j = plain.count(" ", 0, b - back), plain.count(" ", 0, max(b - 1, 0))
                found.append((item, least, words[i].start(), words[j].end()))
        return sorted(found, key=lambda x: (x[0] is None, x[0]))


def item_blocks(benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """The items, normalised, in lists of about block_chars characters; those without a word are left out."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        block = [(r.id, plain) for r in mine if (plain := normalise(r.text))]
        if block:
            yield sorted(block, key=lambda x: (x[0] is None, x))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document and test item that matches a stretch of it within the error budget.

    Texts are compared as lower-case words joined by one space. An item of n characters
    may differ by n * rate edits; it is cut into that many pieces and one, of which at
    least one then stands unchanged in the text. Items are sent in blocks of bounded size,
    documents are read whole and never shuffled.

    Returns doc id, item_id, distance, start, end (code points of the text): the best
    match of each item, ties to the first. Null or empty texts and items match nothing;
    repeated rows give repeated results; other columns are ignored.
    """
    found = None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for block in item_blocks(benchmark, rate, block_chars=block_chars):
        part = rows.mapInArrow(tidied(_finder(_shared_matcher(docs.sparkSession, block, rate))), "doc_id long, item_id long, distance int, start int, end int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, start int, end int")
    return found.withColumnRenamed("doc_id", id_col)


#: The matcher that this worker built last, and of which block: tasks that follow each other in a worker share it.
_BUILT: dict[str, Matcher] = {}


def _shared_matcher(spark, block: list[tuple[int, str]], rate: float):
    """A function that gives the matcher in a worker; the items are broadcast (about block_chars characters), the automaton is built once for each worker."""
    shared, name = spark.sparkContext.broadcast((block, rate)), uuid.uuid4().hex

    def matcher() -> Matcher:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Matcher(*shared.value)
        return _BUILT[name]

    return matcher


def _finder(shared):
    def run(batches):
        matcher = shared()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in matcher.find(t.as_py())]
            yield pa.RecordBatch.from_pydict(
                {k: pa.array([r[n] for r in out], kind) for n, (k, kind) in enumerate((("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())))}
            )

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that match no test item (see find_leaks).

    Null and empty texts match nothing and stay; repeated rows stay or go together; an empty benchmark drops nothing.
    """
    for block in item_blocks(benchmark, rate):
        docs = docs.mapInArrow(tidied(_keeper(_shared_matcher(docs.sparkSession, block, rate), text_col)), docs.schema)
    return docs


def _keeper(shared, text_col):
    def run(batches):
        matcher = shared()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([not matcher.find(t.as_py(), first=True) for t in texts], pa.bool_()))

    return run


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all test items."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

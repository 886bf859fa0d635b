"""Substring dedup by recompression: Spark rounds name words, then runs and pairs of symbols, and shared symbols reveal repeats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import mix, pack, span_hashes, tidied, U64, unpack, Words
from waymill.llm.exchange import CHUNK_BYTES, answer, ask, bits_reader, by_chunk, cut_blobs, grouped, ids_of, join_blobs, key_edges, key_ranges, names_reader, shared_names, store_chunks, texts_of, with_answers
from waymill.scratch import materialise

#: Consecutive words that make a repeat.
WINDOW = 13
#: Rounds of recompression after the words are named; the first also names runs of one symbol.
ROUNDS = 3
_FAR = np.int32(1 << 29)
#: What a question about symbols holds beside its keys: whether several texts of the chunk have it, left symbol and length of its run, right ones (0: none).
_SYMBOL = (np.uint8, np.int64, np.int32, np.int64, np.int32)


@dataclass
class Symbols:
    """Symbols of all texts of a chunk: name (0: not shared), words that it spells, words that fix it, text."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


@dataclass
class Merge:
    """How a round makes new symbols of the old ones, and the question what the new ones are called."""

    symbols: Symbols
    fresh: np.ndarray
    place: np.ndarray
    keys: np.ndarray
    columns: list[np.ndarray]


def word_symbols(names: np.ndarray, doc: np.ndarray) -> Symbols:
    at = np.arange(len(names), dtype=np.int32)
    return Symbols(names, at, at + np.int32(1), at, at + np.int32(1), doc)


def merge(s: Symbols, salt: int, runs: bool) -> Merge:
    """Runs of a shared symbol, if asked for, then each left symbol with the right one after it, become one.

    Sides hang on the symbol (and the length of its run) alone. low and high bound the words that must be
    seen to know that the symbol arises here: where those stand again, so does the symbol. Symbols that are
    not shared stay as they are and fix their neighbours.
    """
    name, start, end, low, high, doc = s.name, s.start, s.end, s.low, s.high, s.doc
    n = len(name)
    coded = name.view(U64)
    if runs and n:
        head = np.ones(n, dtype=bool)
        head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (name[1:] == 0)
        first = np.flatnonzero(head)
        last = np.r_[first[1:], n] - 1
        length = (last - first + 1).astype(np.int32)
        beside = doc[first[1:]] == doc[first[1:] - 1]
        left, right = np.full(len(first), -_FAR), np.full(len(first), _FAR)
        left[1:][beside] = low[first[1:] - 1][beside]
        right[:-1][beside] = high[first[1:]][beside]
        name = name[first]
        alone = name == 0
        low, high = np.where(alone, low[first], left), np.where(alone, high[last], right)
        start, end, doc = start[first], end[last], doc[first]
        coded = name.view(U64) + length.astype(U64) * U64(0xD6E8FEB86659FD93)
    else:
        length = np.ones(n, dtype=np.int32)
    n = len(name)
    side = (coded ^ U64(salt)) * U64(0x9FB21C651E98DF25) > U64((1 << 63) - 1)  # the leading bit
    named = name != 0
    is_left, is_right = named & side, named & ~side
    beside = doc[1:] == doc[:-1]
    with_next = np.zeros(n, dtype=bool)
    with_next[:-1] = is_left[:-1] & is_right[1:] & beside
    taken = np.zeros(n, dtype=bool)
    taken[1:] = with_next[:-1]
    # A left symbol saw what follows it; a right one what came before.
    new_high, new_low = high.copy(), low.copy()
    new_high[is_left] = _FAR
    np.copyto(new_high[:-1], high[1:], where=is_left[:-1] & beside)
    right_alone = is_right & ~taken
    new_low[right_alone] = -_FAR
    np.copyto(new_low[1:], low[:-1], where=right_alone[1:] & beside)
    at = np.flatnonzero(~taken)
    both = with_next[at]
    to = at + both
    new = Symbols(name[at], start[at], end[to], new_low[at], np.where(both, new_high[at], new_high[to]), doc[at])
    fresh = both | (named[at] & (length[at] > 1))
    a, b, pair = at[fresh], to[fresh], both[fresh]
    columns = [name[a], length[a], np.where(pair, name[b], 0), np.where(pair, length[b], 0).astype(np.int32)]
    keys, place, several, columns = _asked(symbol_key(None, *columns), new.doc[fresh], columns)
    return Merge(new, np.flatnonzero(fresh), place, keys, [several, *columns])


def symbol_key(_, left: np.ndarray, length: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """The key of a run or pair of symbols."""
    own = left.view(U64) + length.astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(mix(own) + (right.view(U64) + right_length.astype(U64) * U64(0xC2B2AE3D27D4EB4F)) * U64(0x9E3779B97F4A7C15))


def _asked(key: np.ndarray, doc: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct rows by key, where each row is among them, and whether several texts have it."""
    order, group = grouped(key, *columns)
    head = np.flatnonzero(np.diff(group, prepend=-1))
    place = np.empty(len(key), dtype=np.int64)
    place[order] = group
    several = doc[order[head]] != doc[order[np.r_[head[1:], len(key)] - 1]] if len(key) else head  # doc ascends within a group
    return key[order[head]], place, np.asarray(several, dtype=np.uint8), [c[order[head]] for c in columns]


def rename(m: Merge, names: np.ndarray) -> Symbols:
    """The new symbols, with the names that were given to the distinct ones."""
    m.symbols.name[m.fresh] = names[m.place]
    return m.symbols


def repeats_by_symbols(levels: list[Symbols], hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (by first word) that hold no symbol of one text only, and what they spell in symbols, as keys of 2 x 64 bits.

    A symbol counts in a window if the words that fix it lie within: then every equal window has it. A
    window is spelled by the first such symbol of the highest round, where that stands, and the names of
    the words on either side of it. The second key also holds ``hashes`` of all words, which know nothing of the names.
    """
    words = levels[0]
    n = len(words.name)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    edges = np.zeros(n + 2, dtype=np.int64)
    for s in levels:
        lone = np.flatnonzero((s.name == 0) & (s.high - s.low <= window))
        edges += np.bincount(np.maximum(s.high[lone] - window, 0), minlength=n + 2) - np.bincount(s.low[lone] + 1, minlength=n + 2)
    dead = np.cumsum(edges)[: n - window + 1] > 0
    at = np.flatnonzero((words.doc[window - 1 :] == words.doc[: n - window + 1]) & ~dead)
    if not len(at):
        return at, np.zeros(0, U64), np.zeros(0, U64)
    name, a, b = words.name[at], at.copy(), at + 1
    for s in levels[1:]:
        fixed = np.flatnonzero((s.high - s.low <= window) & (s.name != 0))
        if not len(fixed):
            break
        first = np.searchsorted(s.low[fixed], at.astype(np.int32))
        ok = first < len(fixed)
        ok[ok] = s.high[fixed[first[ok]]] <= at[ok] + window
        chosen = fixed[first[ok]]
        name[ok], a[ok], b[ok] = s.name[chosen], s.start[chosen], s.end[chosen]
    spelled = mix(name.view(U64) + (a - at).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    own = words.name.view(U64) * U64(0x8A5CD789635D2DFF)
    own ^= own >> U64(32)
    key = mix(mix(spelled + span_hashes(own, at, a)) + span_hashes(own, b, at + window))
    return at, key, mix(spelled ^ span_hashes(hashes, at, at + window))


def _least_by_key(keys: np.ndarray, check: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their check, the least document of each, and where each row is among them."""
    order, group = grouped(keys, check)
    head = np.flatnonzero(np.diff(group, prepend=-1))
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = group
    least = np.minimum.reduceat(docs[order], head) if len(keys) else docs
    return keys[order[head]], check[order[head]], least, place


def _earlier(keys: np.ndarray, check: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the key."""
    _, _, least, place = _least_by_key(keys, check, docs)
    return least[place] < docs


class Chunk:
    """The words of some texts: each different one once, in the order of its hash.

    index: which of them each word is; counts: words of each text; ids: of the texts; edges: where the
    ranges of hashes begin.
    """

    def __init__(self, blob: bytes):
        words, *arrays = cut_blobs(blob)
        self.words = zstandard.ZstdDecompressor().decompress(words) if words else b""
        self.index, self.counts, self.ids, self.edges = (unpack(b, k) for b, k in zip(arrays, (np.int32, np.int64, np.int64, np.int64), strict=True))
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    @staticmethod
    def pack(batch: pa.RecordBatch, id_col: str, text_col: str, ranges: int) -> bytes:
        found = Words(texts_of(batch, text_col))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found.distinct), dtype=U64, count=len(found.distinct))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words = b"".join([found.distinct[i] for i in order.tolist()])
        index = rank[found.index] if len(found) else np.zeros(0, np.int32)
        arrays = (index, np.diff(found.first), ids_of(batch, id_col), key_edges(hashes[order], ranges))
        return join_blobs([zstandard.ZstdCompressor(level=1).compress(words) if words else b"", *map(pack, arrays)])

    def hashes(self, seed: int = 0) -> np.ndarray:
        """XXH3 of the different words, by their bytes."""
        ends = (np.flatnonzero(np.frombuffer(self.words, np.uint8) == 32) + 1).tolist()
        return np.fromiter((xxhash.xxh3_64_intdigest(self.words[a:b], seed) for a, b in zip([0, *ends[:-1]], ends, strict=bool(ends))), dtype=U64, count=len(ends))

    def levels(self, names: Callable, rounds: int) -> list[Symbols]:
        """Symbols of the words and of so many rounds, which have been named."""
        levels = [word_symbols(names(1, None, self.edges)[self.index] if len(self.index) else np.zeros(0, np.int64), self.doc)]
        for k in range(rounds):
            m = merge(levels[-1], _salt(k), k == 0)
            levels.append(rename(m, names(k + 2, m.keys)))
        return levels

    def repeats(self, names: Callable, rounds: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        levels = self.levels(names, rounds)
        return repeats_by_symbols(levels, self.hashes(1)[self.index] if len(self.index) else np.zeros(0, U64), window)

    def texts(self, keep: np.ndarray) -> list[bytes]:
        """Of each text the words to keep, joined by one space."""
        bounds = np.r_[0, np.flatnonzero(np.frombuffer(self.words, np.uint8) == 32) + 1].astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(self.words)])
        taken = self.index[keep]
        whole = column.take(pa.array(taken)).buffers()[2].to_pybytes() if len(taken) else b""
        sizes = np.zeros(len(keep) + 1, dtype=np.int64)
        sizes[1:][keep] = np.diff(bounds)[taken]
        ends = np.cumsum(sizes)[np.r_[0, np.cumsum(self.counts)]].tolist()
        return [whole[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _salt(k: int) -> int:
    return (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)


def covered_words(n: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows that begin at ``at`` cover."""
    edges = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + window, n), minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove each word covered by a run of ``window`` words that also starts in a document of smaller id.

    Words are what stands between ASCII white space; windows are judged on the input.
    Returns ``id_col``, n_words, n_removed, spans (first word and end of each removed run,
    counted in words) and ``text_col``: the kept words joined by one space.

    Every row gives one row. Null or empty text: no words, kept text empty. Null ids come
    after all others and are not smaller than each other; nor are rows of the same id, so
    repeated rows all stay or all lose the same words. Other columns are ignored.

    Round by round Spark gives a number to each word, then to each run and pair of neighbouring
    symbols (see merge) that more than one text has, the same wherever it stands; what only one text has
    ends there. A window that holds such an end is no repeat; all others are spelled in symbols (see
    repeats_by_symbols), and a last round asks whether a smaller document has the same spelling. Words are
    told apart by their bytes within a chunk and by 64 bits of XXH3 between chunks, symbols exactly;
    spellings by 128 bits, of which half come from a second hash of the words. So two windows are taken for each
    other only if both hashes of differing words agree. More ``rounds`` leave fewer windows to the last one.
    """
    ranges = key_ranges(docs.sparkSession)
    chunks = store_chunks(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), text_col, chunk_bytes, lambda batch: Chunk.pack(batch, id_col, text_col, ranges))
    names, bits = names_reader(chunks), bits_reader(chunks)

    def words(chunk):
        first, last = (np.zeros(int(chunk.edges[-1]), np.int32) for _ in range(2))
        last[chunk.index] = chunk.doc
        first[chunk.index[::-1]] = chunk.doc[::-1]
        return chunk.hashes(), [(first != last).astype(np.uint8)]

    def symbols(k):
        def question(chunk, names):
            m = merge(chunk.levels(names, k)[-1], _salt(k), k == 0)
            return m.keys, m.columns

        return question

    def repeats(chunk, names):
        at, key, check = chunk.repeats(names, rounds, window)
        keys, check, least, _ = _least_by_key(key, check, chunk.ids[chunk.doc[at]])
        return keys, [check, least]

    said = materialise(answer(ask(chunks, words, open_=Chunk), shared_names, (np.uint8,), 1, one_row=False), "word-names")
    for k in range(rounds):
        asked = ask(chunks, symbols(k), by_chunk(said), Chunk, names, spare=True)
        said = said.union(materialise(answer(asked, shared_names, _SYMBOL, k + 2, one_row=False, key_of=symbol_key), "symbol-names"))
    named = by_chunk(said)
    earlier = answer(ask(chunks, repeats, named, Chunk, names), _earlier, (U64, np.int64))
    schema = f"`{id_col}` long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, `{text_col}` string"
    arrow = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), (text_col, pa.string())])

    def finish(batches):
        for rows in batches:
            for row in rows.to_pylist():
                chunk = Chunk(row["blob"])
                at, key, check = chunk.repeats(names(row["answers"]), rounds, window)
                owners = chunk.ids[chunk.doc[at]]
                keys, _, least, place = _least_by_key(key, check, owners)
                gone = covered_words(len(chunk.index), at[bits(row["more"])(keys)[place] | (least[place] < owners)] if len(at) else at, window)
                first = np.r_[0, np.cumsum(chunk.counts)]
                removed = np.diff(np.r_[0, np.cumsum(gone)][first])
                texts = pa.array(chunk.texts(~gone), pa.binary()).cast(pa.string())
                ids = pa.array(chunk.ids, pa.int64(), mask=chunk.ids == np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([ids, pa.array(chunk.counts, pa.int64()), pa.array(removed, pa.int64()), _spans(chunk.doc, first, gone), texts], schema=arrow)

    both = with_answers(with_answers(chunks, named), earlier.withColumnRenamed("answers", "more"))
    return both.select("blob", "answers", "more").mapInArrow(tidied(finish), schema)


def _spans(doc: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.Array:
    head, tail = gone.copy(), gone.copy()
    if len(gone) > 1:
        same = doc[1:] == doc[:-1]
        head[1:] &= ~(gone[:-1] & same)
        tail[:-1] &= ~(gone[1:] & same)
    a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
    base = first[doc[a]]
    pairs = pa.StructArray.from_arrays([pa.array(a - base, pa.int32()), pa.array(b - base, pa.int32())], ["start", "end"])
    offsets = np.searchsorted(a, first)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    """Repeats of 13 words removed from all documents."""
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: op7_substrings for doc_ids that are not null and differ.
OP7_SQL = r"""WITH split AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS run FROM starts),
firsts AS (SELECT run, min(doc_id) AS first_id FROM windows GROUP BY run),
repeats AS (SELECT w.doc_id, w.i FROM windows w JOIN firsts f ON w.run = f.run AND f.first_id < w.doc_id),
covered AS (SELECT DISTINCT doc_id, i + k AS p FROM repeats CROSS JOIN range(13) r(k)),
gone AS (SELECT doc_id, list(p) AS places FROM covered GROUP BY doc_id),
kept AS (
  SELECT doc_id, word, p FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM split)
  ANTI JOIN covered USING (doc_id, p)),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM kept GROUP BY doc_id)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, coalesce(len(g.places), 0)::BIGINT AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id LEFT JOIN texts t ON s.doc_id = t.doc_id
"""

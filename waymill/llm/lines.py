"""Line dedup: equal lines by hash, lines one edit apart by a deletion-neighbourhood join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import materialise, tidied, U64
from waymill.llm.exchange import CHUNK_BYTES, answer, ask, bits_reader, ids_of, opened, store_chunks, texts_of, with_answers

_BLANK = b" \t\r\v\f"
#: Pieces that a line is cut into; one edit leaves all but one as they are.
PIECES = 4
_OPEN = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("line", pa.int32()), ("doc", pa.int64()), ("text", pa.string()), ("pieces", pa.list_(pa.int32()))])
_KEYS = pa.schema([("doc", pa.int64()), ("line", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("kind", pa.int8())])


class Lines:
    """The lines of a chunk that are not blank.

    By line, in the order of (doc, line): hash and check (128 bits of its bytes together),
    doc (id), row (place in the chunk), line (place in the text).
    """

    def __init__(self, batch: pa.RecordBatch, id_col: str, text_col: str):
        self.texts = [t.split(b"\n") for t in texts_of(batch, text_col)]
        ids = ids_of(batch, id_col)
        digests, rows, numbers = [], [], []
        for row, lines in enumerate(self.texts):
            for i, line in enumerate(lines):
                if line.strip(_BLANK):
                    digests.append(xxhash.xxh3_128_digest(line))
                    rows.append(row)
                    numbers.append(i)
        pairs = np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 2).astype(U64)
        row, line = np.array(rows, dtype=np.int64), np.array(numbers, dtype=np.int64)
        order = np.lexsort((line, ids[row]))
        self.hash, self.check = pairs[order, 0], pairs[order, 1]
        self.row, self.line = row[order], line[order]
        self.doc = ids[self.row]
        # The first line of each text, and for every line its first.
        order, head, group = _groups(self.hash, self.check)
        self.first = order[head]
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = group

    def text(self, at: int) -> str:
        return self.texts[self.row[at]][self.line[at]].decode("utf-8", "surrogatepass")

    def question(self):
        """Distinct lines with the place of their first."""
        return self.hash[self.first], [self.check[self.first], self.doc[self.first], self.line[self.first]]

    def gone(self, earlier: np.ndarray) -> np.ndarray:
        """Lines that have an equal before them."""
        first = self.first[self.group]
        return earlier[self.group] | (self.doc > self.doc[first]) | (self.line > self.line[first])

    def pieces(self, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece keys of the lines whose first has no equal before it anywhere: key, the line, the number of the piece."""
        keys: list[int] = []
        owner = []
        for at in self.first[~earlier].tolist():
            line = self.text(at)
            keys += piece_keys(line)
            owner.append(at)
        each = 2 * PIECES
        return np.array(keys, dtype=U64), np.repeat(np.array(owner, dtype=np.int64), each), np.tile(np.arange(each), len(owner))


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the columns, where each group of equals begins in it, and the group of each place."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _seen_before(keys, check, doc, line) -> np.ndarray:
    """Whether the same line stands at an earlier place."""
    order, head, group = _groups(keys, check)
    place = np.lexsort((line, doc))
    rank = np.empty(len(keys), dtype=np.int64)  # equal places rank alike
    step = np.r_[False, (doc[place][1:] != doc[place][:-1]) | (line[place][1:] != line[place][:-1])]
    rank[place] = np.cumsum(step)
    least = np.minimum.reduceat(rank[order], head)
    out = np.empty(len(keys), dtype=bool)
    out[order] = least[group] < rank[order]
    return out


def _asked_often(keys, several) -> np.ndarray:
    """Whether another line has the piece."""
    order, head, group = _groups(keys)
    often = (np.diff(np.r_[head, len(keys)]) > 1) | (np.maximum.reduceat(several[order], head) > 0)
    out = np.empty(len(keys), dtype=bool)
    out[order] = often[group]
    return out


def _cuts(size: int) -> list[tuple[int, int]]:
    return [(size * j // PIECES, size * (j + 1) // PIECES) for j in range(PIECES)]


def piece_keys(line: str) -> list[int]:
    """Keys of a line without one of its pieces, for each piece; two lines one edit apart share one at least.

    If the lengths are equal, all is equal around the piece with the edit. If one is longer by
    one, it also counts as a line of the shorter length: what stands before the piece is
    measured from the beginning, what stands behind it from the end.
    """
    n = len(line)
    out = []
    for size in (n, n - 1):
        for j, (a, b) in enumerate(_cuts(size)):
            out.append(xxhash.xxh3_64_intdigest(f"{size}.{j}.{line[:a]}\n{line[n - size + b :]}".encode("utf-8", "surrogatepass")))
    return out


def neighbourhood(line: str, pieces: list[int]) -> list[tuple[int, int]]:
    """(128-bit key, kind) of the line and of its variants with a deletion in one of the pieces, numbered as by piece_keys.

    Kind 0: the variant with the place of its deletion; lines that share it are equal or differ
    in the character there. Kind 1: the line itself, kind 2: a variant without the place; one
    line's kind 1 and another's kind 2 are alike if the second has one character more.
    """
    n = len(line)
    starts = np.r_[0, np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in line])].tolist()
    whole = line.encode("utf-8", "surrogatepass")
    out = [(xxhash.xxh3_128_intdigest(whole, 1), 1)]
    places: tuple[set[int], set[int]] = (set(), set())
    for piece in pieces:
        shorter, j = divmod(piece, PIECES)
        a, b = _cuts(n - shorter)[j]
        places[shorter].update(range(a, b + shorter))
    for shorter in (0, 1):
        for i in places[shorter]:
            variant = whole[: starts[i]] + whole[starts[i + 1] :]
            out.append((xxhash.xxh3_128_intdigest(variant, 1), 2) if shorter else (xxhash.xxh3_128_intdigest(variant, i + 2), 0))
    return out


def _distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, and whether several lines have one."""
    order, head, _ = _groups(keys)
    least, most = (f.reduceat(owner[order], head) if len(head) else head for f in (np.minimum, np.maximum))
    return keys[order][head], [(least != most).astype(np.uint8)]


def near_lines(open_lines: DataFrame) -> DataFrame:
    """(doc, line) of the lines that have another one edit away at an earlier place.

    open_lines: doc, line, text, pieces (those that another line has), chunk, row; texts distinct.
    Emits every line's deletion variants in these pieces as keys, joins each key to the earliest line that has it, and verifies the
    distance of the two texts. A key needs no more than its earliest lines, so a group of
    any size costs one row for each of its keys.
    """

    def emit(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in _KEYS.names}
            for doc, line, text, pieces in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for key, kind in neighbourhood(text, pieces):
                    out["doc"].append(doc)
                    out["line"].append(line)
                    out["hi"].append((key >> 64) - (1 << 63))
                    out["lo"].append((key & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    out["kind"].append(kind)
                if len(out["doc"]) > 100_000:
                    yield pa.RecordBatch.from_pydict(out, schema=_KEYS)
                    out = {k: [] for k in _KEYS.names}
            yield pa.RecordBatch.from_pydict(out, schema=_KEYS)

    keys = open_lines.select("doc", "line", "text", "pieces").mapInArrow(tidied(emit), "doc long, line int, hi long, lo long, kind byte")
    keys = keys.withColumn("at", F.struct("doc", "line")).drop("doc", "line")
    firsts = keys.groupBy("hi", "lo").agg(*[F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"first{k}") for k in range(3)])
    partner = F.when(F.col("kind") == 0, F.col("first0")).when(F.col("kind") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = keys.join(firsts, ["hi", "lo"]).withColumn("partner", partner).where("partner < at").select("at", "partner").distinct()
    texts = open_lines.select(F.struct("doc", "line").alias("at"), "text")
    pairs = pairs.join(texts, "at").join(texts.select(F.col("at").alias("partner"), F.col("text").alias("other")), "partner")
    return pairs.where(F.levenshtein("text", "other", 1) >= 0).select("at.doc", "at.line").distinct()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove each line that is equal to a line at an earlier place or one edit away from it.

    Lines are what stands between line feeds, unchanged; places are ordered by (id, number of the line),
    null ids last. One edit is one code point put in, taken out or replaced, in a line of any length.
    Blank lines are kept and never count.

    Returns the columns of docs with the remaining lines in ``text_col``, and n_lines and n_dropped
    (blank lines left out). Every row gives one row; null text stays null, empty text empty.
    Lines at the same place, as of rows with the same id, don't remove each other. Columns of any
    other name are kept, but n_lines and n_dropped are replaced.

    Rounds: equal lines; of those left, which are like another line around one of PIECES pieces (all
    others have no line one edit away); only of these, in that piece, the deletion variants are joined.
    """
    docs = docs.drop("n_lines", "n_dropped")
    chunks = store_chunks(docs, text_col, chunk_bytes)
    bits = bits_reader(chunks)

    def lines(batch):
        return Lines(batch, id_col, text_col).question()

    def pieces(batch, earlier):
        found = Lines(batch, id_col, text_col)
        keys, owner, _ = found.pieces(earlier(found.question()[0]))
        return _distinct(keys, owner)

    def emit(batches):
        for rows in batches:
            for row in rows.to_pylist():
                found = Lines(opened(row["blob"]), id_col, text_col)
                keys, owner, number = found.pieces(bits(row["answers"])(found.question()[0]))
                asked, _ = _distinct(keys, owner)
                hit = np.isin(keys, asked[bits(row["more"])(asked)])
                chosen: dict[int, list[int]] = {}
                for at, j in zip(owner[hit].tolist(), number[hit].tolist(), strict=True):
                    chosen.setdefault(at, []).append(j)
                at = np.array(list(chosen), dtype=np.int64)
                texts = [found.text(i) for i in chosen]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(at), pa.int64()), pa.array(found.row[at], pa.int32()), pa.array(found.line[at], pa.int32()), pa.array(found.doc[at], pa.int64()), pa.array(texts, pa.string()), pa.array(list(chosen.values()), pa.list_(pa.int32()))], schema=_OPEN)

    earlier = answer(ask(chunks, lines), _seen_before, (U64, np.int64, np.int64))
    more = answer(ask(chunks, pieces, earlier), _asked_often, (np.uint8,)).withColumnRenamed("answers", "more")
    open_lines = with_answers(with_answers(chunks, earlier), more).select("chunk", "blob", "answers", "more").mapInArrow(tidied(emit), "chunk long, row int, line int, doc long, text string, pieces array<int>")
    open_lines = materialise(open_lines, "open-lines")
    near = open_lines.join(near_lines(open_lines), ["doc", "line"]).groupBy("chunk").agg(F.collect_list(F.struct("row", "line")).alias("near"))

    def finish(batches):
        for rows in batches:
            for row in rows.to_pylist():
                batch = opened(row["blob"])
                found = Lines(batch, id_col, text_col)
                gone = found.gone(bits(row["answers"])(found.question()[0]))
                drop: dict[int, set[int]] = {}
                for r, i in zip(found.row[gone].tolist(), found.line[gone].tolist(), strict=True):
                    drop.setdefault(r, set()).add(i)
                for place in row["near"] or ():
                    drop.setdefault(place["row"], set()).add(place["line"])
                column = batch.column(batch.schema.get_field_index(text_col))
                texts = [None if null else b"\n".join(x for i, x in enumerate(t) if i not in drop[r]) if r in drop else b"\n".join(t) for r, (t, null) in enumerate(zip(found.texts, column.is_null().to_pylist(), strict=True))]
                columns = list(batch.columns)
                columns[batch.schema.get_field_index(text_col)] = pa.array(texts, pa.binary()).cast(pa.string())
                counts = np.bincount(found.row, minlength=batch.num_rows)
                dropped = [len(drop.get(r, ())) for r in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*batch.schema.names, "n_lines", "n_dropped"])

    schema = docs.schema
    schema = type(schema)(list(schema.fields)).add("n_lines", "long").add("n_dropped", "long")
    return with_answers(with_answers(chunks, earlier).select("chunk", "blob", "answers"), near).select("blob", "answers", "near").mapInArrow(tidied(finish), schema)


def drop_line_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs without repeated lines; a text that loses its every line goes, one that had none stays."""
    out = drop_repeated_lines(docs, id_col, text_col)
    return out.where("n_dropped < n_lines or n_lines = 0").drop("n_lines", "n_dropped")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of all documents that have an equal or one an edit away before them: how many each text has, loses, and what is left."""
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: op9_line_dedup for doc_ids that are not null and differ.
OP9_SQL = r"""WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(len(parts))) AS n, unnest(parts) AS line FROM split),
counted AS (SELECT *, regexp_matches(line, '[^ \t\r\x0B\x0C]') AS counts FROM lines),
firsts AS (SELECT line, length(line) AS size, min({'doc_id': doc_id, 'n': n}) AS place FROM counted WHERE counts GROUP BY line),
-- Of two lines one edit apart the first or the last half of the shorter length is the same.
sized AS (SELECT line, size, place, size - shorter AS least FROM firsts, range(2) s(shorter)),
halves AS (
  SELECT line, size, place, least, 'left' AS side, left(line, least // 2) AS half FROM sized
  UNION ALL SELECT line, size, place, least, 'right', right(line, least // 2) FROM sized),
pairs AS (
  SELECT DISTINCT a.line, b.line AS other, b.place
  FROM halves a JOIN halves b ON a.least = b.least AND a.side = b.side AND a.half = b.half
  WHERE b.place < a.place AND least(a.size, b.size) = a.least AND levenshtein(a.line, b.line) <= 4),
ranked AS (
  SELECT *, CASE WHEN length(line) <= length(other) THEN line ELSE other END AS short,
         CASE WHEN length(line) <= length(other) THEN other ELSE line END AS long
  FROM pairs),
near AS (
  SELECT line, min(place) AS place FROM ranked
  WHERE len(list_filter(range(length(long)), lambda i: left(short, i) = left(long, i)
                        AND substr(short, i + 2 - (length(long) - length(short))) = substr(long, i + 2))) > 0
  GROUP BY line),
judged AS (
  SELECT c.doc_id, c.n, c.line, c.counts, c.counts AND (f.place < {'doc_id': c.doc_id, 'n': c.n} OR coalesce(e.place < {'doc_id': c.doc_id, 'n': c.n}, false)) AS gone
  FROM counted c LEFT JOIN firsts f ON c.line = f.line LEFT JOIN near e ON c.line = e.line),
texts AS (
  SELECT doc_id, count(*) FILTER (counts) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_dropped, 0)::BIGINT AS n_dropped, sha256(t.text) AS kept_sha256
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id
"""

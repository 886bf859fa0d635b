"""Corpus-wide questions of whole texts without a row for each word.

The texts lie in numbered chunks in a table bucketed by chunk. A round asks: each chunk
sends its distinct keys, cut by key range; each range answers one bit, or a name, for each key
that it got; the answers go back to the chunk, which makes the same keys again and reads them.
So a key is sent once by each chunk, however often it occurs there, an answer takes one
bit or a few bytes, and the texts themselves are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import pack, release, scratch_path, slices, tidied, U64, unpack

#: Bytes of text that one chunk holds, about, unless one text is longer.
CHUNK_BYTES = 2_000_000
_ASKED = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])
_ANSWERED = pa.schema([("chunk", pa.int64()), ("round", pa.int32()), ("range", pa.int32()), ("bits", pa.binary())])
#: Sorted keys, none twice, and columns beside them.
Question = tuple[np.ndarray, list[np.ndarray]]


def store_chunks(docs: DataFrame, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, kept: Callable[[pa.RecordBatch], bytes] | None = None) -> DataFrame:
    """docs in a table of chunks (chunk, blob), bucketed by chunk on the shared folder.

    kept: what to keep of a chunk, if it isn't all columns as they are.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, text_col, chunk_bytes)):
            blob = (kept or whole)(batch)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([first + i], pa.int64()), "blob": pa.array([blob], pa.binary())})

    name = f"waymill_{uuid.uuid4().hex}"
    stored = docs.mapInArrow(tidied(run), "chunk long, blob binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored.write.format("parquet").option("compression", "uncompressed").option("path", scratch_path(spark, name)).bucketBy(buckets, "chunk").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the catalog keeps nothing
    return table


def whole(batch: pa.RecordBatch) -> bytes:
    """A chunk with all its columns, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(blob: bytes) -> pa.RecordBatch:
    """The rows of a chunk."""
    return pa.ipc.open_stream(blob).read_next_batch()


def texts_of(batch: pa.RecordBatch, text_col: str = "text") -> list[bytes]:
    """UTF-8 of the texts; empty for null."""
    column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
    return [t if t is not None else b"" for t in column.to_pylist()]


def ids_of(batch: pa.RecordBatch, id_col: str = "doc_id") -> np.ndarray:
    """Ids as int64; null after all others."""
    column = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
    return np.asarray(column.fill_null(np.iinfo(np.int64).max))


def ask(chunks: DataFrame, questions: Callable[..., Question], answers: DataFrame | None = None, open_: Callable = opened, reader: Callable | None = None, spare: bool = False) -> DataFrame:
    """What each chunk asks: questions(open_(blob), what ``reader``, by default of bits, makes of earlier answers).

    spare: leave the keys out of what is sent, as the other side makes them from the columns.
    """
    ranges, later = _ranges(chunks), answers is not None
    reader = reader or _bits_of(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, columns = questions(open_(row["blob"]), *([reader(row["answers"])] if later else []))
                edges = key_edges(keys, ranges)
                full = np.flatnonzero(np.diff(edges)).tolist()
                blobs = [join_blobs([pack(c[edges[r] : edges[r + 1]]) for c in (columns if spare else (keys, *columns))]) for r in full]
                sizes = [int(edges[r + 1] - edges[r]) for r in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], schema=_ASKED)

    return with_answers(chunks, answers).mapInArrow(tidied(run), "range int, chunk long, n int, blob binary")


def answer(asked: DataFrame, judge: Callable[..., np.ndarray], kinds: tuple = (), round_: int = 0, one_row: bool = True, key_of: Callable | None = None) -> DataFrame:
    """What judge(keys, *columns), which sees a range of keys from all chunks, says of each key: a bit, or a number if round_ is not 0.

    kinds: the dtypes of the columns beside the keys; key_of: makes the keys of them, if they were spared.
    One row for each chunk, or one for each chunk and range.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        sizes = table.column("n").to_pylist()
        sent = kinds if key_of else (U64, *kinds)
        parts = [[unpack(b, k) for b, k in zip(cut_blobs(blob), sent, strict=True)] for blob in table.column("blob").to_pylist()]
        columns = [np.concatenate(column) for column in zip(*parts, strict=True)]
        said = judge(*([key_of(*columns)] if key_of else []), *columns)
        release()
        edges = np.cumsum([0, *sizes])
        of = pack if round_ else lambda part: np.packbits(part).tobytes()
        bits = [of(said[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.Table.from_arrays([table.column("chunk"), pa.array([round_] * len(sizes), pa.int32()), table.column("range"), pa.array(bits, pa.binary())], schema=_ANSWERED)

    said = asked.groupBy("range").applyInArrow(run, "chunk long, round int, range int, bits binary")
    return by_chunk(said) if one_row else said


def by_chunk(said: DataFrame) -> DataFrame:
    """Answers, a row for each chunk."""
    return said.groupBy("chunk").agg(F.collect_list(F.struct("round", "range", "bits")).alias("answers"))


def shared_names(keys: np.ndarray, several: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Numbers from 1 for keys that several chunks ask for, or one for several texts; 0 for others. Keys are told apart by the columns too."""
    order, group = grouped(keys, *columns)
    head = np.flatnonzero(np.diff(group, prepend=-1))
    shared = (np.diff(np.r_[head, len(keys)]) > 1) | (np.maximum.reduceat(several[order], head) > 0)
    number = np.where(shared, np.cumsum(shared), 0)
    out = np.empty(len(keys), dtype=np.uint64 if len(keys) >> 32 else np.uint32)
    out[order] = number[group]
    return out


def grouped(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows stand together, keys ascending, and the number of each place's group."""
    order = np.argsort(keys, kind="stable")
    new = np.zeros(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    clash = np.zeros(len(keys), dtype=bool)
    for c in columns:
        clash[1:] |= c[order][1:] != c[order][:-1]
    if (clash & ~new).any():  # different rows of one key: let the columns decide
        order = np.lexsort((*columns[::-1], keys))
        new[1:] = keys[order][1:] != keys[order][:-1]
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.cumsum(new)


def names_reader(chunks: DataFrame) -> Callable[[list | None], Callable[[int, np.ndarray], np.ndarray]]:
    """Makes of a row's answers a function from a round and the keys that were asked in it to their names: 0, or a number that no other key of any round has."""
    ranges = _ranges(chunks)

    def names(answers: list | None):
        def read(round_: int, keys: np.ndarray | None, edges: np.ndarray | None = None) -> np.ndarray:
            edges = key_edges(keys, ranges) if edges is None else edges
            out = np.zeros(edges[-1], dtype=np.int64)
            for row in answers or ():
                if row["round"] == round_:
                    a, b = edges[row["range"]], edges[row["range"] + 1]
                    numbers = unpack(row["bits"], np.uint32)
                    numbers = (numbers if len(numbers) == b - a else unpack(row["bits"], np.uint64)).astype(np.int64)
                    out[a:b] = np.where(numbers, numbers + (round_ << 58) + (row["range"] << 34), 0)
            return out

        return read

    return names


def with_answers(chunks: DataFrame, answers: DataFrame | None) -> DataFrame:
    return chunks if answers is None else chunks.join(answers, "chunk", "left")


def bits_reader(chunks: DataFrame) -> Callable[[list | None], Callable[[np.ndarray], np.ndarray]]:
    """Makes of a row's answers a function from the keys that were asked to their bits."""
    return _bits_of(_ranges(chunks))


def _ranges(chunks: DataFrame) -> int:
    return key_ranges(chunks.sparkSession)


def key_ranges(spark) -> int:
    """Into how many ranges keys are cut."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_edges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each key range begins in sorted keys, and the last ends."""
    edges = np.searchsorted(keys, np.arange(1, ranges).astype(U64) * U64((1 << 64) // ranges))
    return np.r_[0, edges, len(keys)]


def _bits_of(ranges: int):
    def bits(answers: list | None):
        def read(keys: np.ndarray) -> np.ndarray:
            edges = key_edges(keys, ranges)
            out = np.zeros(len(keys), dtype=bool)
            for row in answers or ():
                a, b = edges[row["range"]], edges[row["range"] + 1]
                out[a:b] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=b - a).view(bool)
            return out

        return read

    return bits


def join_blobs(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes() + b"".join(parts)


def cut_blobs(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at = 8 * (n + 1)
    out = []
    for size in np.frombuffer(blob, np.int64, n, 8).tolist():
        out.append(blob[at : at + size])
        at += size
    return out

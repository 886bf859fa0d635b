"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import materialise, mix, squeeze, tidied, U64, windows, Words
from waymill.llm.exchange import CHUNK_BYTES, opened, store_chunks, texts_of

#: Words of a shingle, least similarity, sketches of a document, shingles in a sketch.
SHINGLE, SIMILARITY, SKETCHES, ORDERED = 5, 0.8, 20, 4
#: Rows of one bucket that one call compares with as many others; shingles of a text that it compares.
BLOCK_ROWS, THINNED = 512, 2048
#: Shingles of the partners that one copy of a text is aligned with.
BLOCK_SHINGLES = 2_000_000
#: Up to so many shingles, texts also meet by exact keys.
EXACT_SHINGLES = 17
_SALTS = mix(np.arange(1, SKETCHES + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
_NODES = pa.schema([("id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("chunk", pa.int64()), ("row", pa.int32()), ("n", pa.int32()), ("sketches", pa.list_(pa.int64())), ("exact", pa.list_(pa.int64()))])


def labelled_shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, told apart by how often they came before in the text, and bounds by text.

    A text of fewer words than a shingle has one shingle, all its words; without words none.
    """
    hashes = windows(words.hashes, size)
    counts = np.diff(words.first)
    owner = words.doc[: len(hashes)]
    whole = owner == words.doc[size - 1 :] if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[whole], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        brief = np.array([xxhash.xxh3_64_intdigest(words.hashes[words.first[d] : words.first[d + 1]].tobytes()) for d in short], dtype=U64)
        hashes, owner = np.r_[hashes, brief], np.r_[owner, short]
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    order = np.lexsort((hashes, owner))  # stable: equal ones stay in the order of the text
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    head = np.flatnonzero(new)
    nth = np.empty(len(order), dtype=np.int64)
    nth[order] = np.arange(len(order)) - head[np.cumsum(new) - 1] if len(order) else 0
    return mix(hashes + nth.astype(U64) * U64(0xC2B2AE3D27D4EB4F)), np.searchsorted(owner, np.arange(len(counts) + 1))


def sketch(shingles: np.ndarray, ordered: int = ORDERED) -> np.ndarray:
    """For each salt a hash of the least shingles under it, in the order of the text."""
    out = np.zeros(len(_SALTS), dtype=U64)
    step = max(1, 2_000_000 // max(1, len(shingles)))
    for a in range(0, len(_SALTS), step):
        salts = _SALTS[a : a + step, None]
        rank = (shingles[None, :] ^ salts) * (salts | U64(1))
        rank ^= rank >> U64(32)
        if len(shingles) > ordered:
            at = np.sort(np.argpartition(rank, ordered - 1, axis=1)[:, :ordered], axis=1)
        else:
            at = np.broadcast_to(np.arange(len(shingles)), (len(salts), len(shingles)))
        value = salts[:, 0].copy()
        for k in range(at.shape[1]):
            value = mix(value * U64(0x100000001B3) + shingles[at[:, k]])
        out[a : a + step] = value
    return out


def exact_keys(shingles: np.ndarray, ordered: int = ORDERED) -> np.ndarray:
    """Keys of which any two similar texts of at most EXACT_SHINGLES shingles share one; none for longer texts.

    Of n shingles such a pair has t = ceil(SIMILARITY * n) at least in common, so its ``ordered``
    least common ones are among the n - t + ordered least of either: each choice of them is a key.
    Texts of fewer shingles than ``ordered`` are similar only if they have the same.
    """
    n = len(shingles)
    if not n or n > EXACT_SHINGLES:
        return np.zeros(0, dtype=U64)
    size = min(ordered, n)
    least = np.sort(shingles)[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + size]
    chosen = np.array(list(combinations(range(len(least)), size)))
    value = np.full(len(chosen), size, dtype=U64)
    for k in range(size):
        value = mix(value * U64(0x100000001B3) + least[chosen[:, k]])
    return value


def ordered_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of shingles that stand in both texts in the same order: c / (len(a) + len(b) - c); 0 if under ``least``.

    c is the longest common subsequence. Labelled shingles are distinct in a text, so that is
    the longest increasing run of places among the common ones. With c matches two places in
    an alignment differ by max(len) - c at most: pairs outside of that band are left out.
    """
    need = int(np.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    if not len(a) or not len(b) or min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = max(len(a), len(b)) - need
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        c = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        c = len(tails)
    return c / (len(a) + len(b) - c) if c >= need else 0.0


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of links (a, b).

    Labels fall to the least of the neighbours', then to the label of the label, until none
    changes. Each round is written out; only a count comes to the driver.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        heads = labels.select(F.col("node").alias("head"), F.col("label").alias("further"))
        lower = lower.join(heads, F.col("label") == F.col("head")).select("node", F.least("label", "further").alias("label"), "old")
        lower = materialise(lower, "cc-labels")
        labels = lower.select("node", "label")
        if lower.where("label <> old").isEmpty():
            return labels


def _nodes(id_col: str, text_col: str):
    def run(batches):
        for rows in batches:
            for row in rows.to_pylist():
                batch = opened(row["blob"])
                words = Words(texts_of(batch, text_col))
                shingles, bounds = labelled_shingles(words)
                ids, digests = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()).to_pylist(), words.digests()
                out: dict[str, list] = {k: [] for k in _NODES.names}
                for r, id_ in enumerate(ids):
                    own = shingles[bounds[r] : bounds[r + 1]]
                    if id_ is None or not len(own):
                        continue
                    hi, lo = (int.from_bytes(digests[r][k : k + 8], "little", signed=True) for k in (0, 8))
                    values = (id_, hi, lo, row["chunk"], r, len(own), sketch(own).view(np.int64), exact_keys(own).view(np.int64))
                    for k, v in zip(_NODES.names, values, strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=_NODES)

    return run


def _squeezed(text: bytes) -> bytes | None:
    return squeeze(text.decode("utf-8", "surrogatepass"))


def thinned(text: bytes) -> bytes:
    """A sample of a text's labelled shingles: all, or those whose hash ends in the fewest zero bits that leave THINNED; led by how many."""
    found = labelled_shingles(Words([text]))[0].astype(np.uint32)
    bits = 0
    while len(found) > THINNED:
        bits += 1
        found = found[found & np.uint32((1 << bits) - 1) == 0]
    return np.r_[np.uint32(bits), np.unique(found)].tobytes()


def _payload(text_col: str, of):
    def run(batches):
        for rows in batches:
            for row in rows.to_pylist():
                texts = texts_of(opened(row["blob"]), text_col)
                made = [of(texts[place["row"]]) for place in row["places"]]
                yield pa.RecordBatch.from_arrays([pa.array([p["id"] for p in row["places"]], pa.int64()), pa.array(made, pa.binary())], names=["id", "text"])

    return run


def payload(ids: DataFrame, of, name: str, chunks: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(id, text): of(text) for the nodes of these distinct ids. Only this leaves the chunks."""
    places = nodes.join(ids, "id", "left_semi").groupBy("chunk").agg(F.collect_list(F.struct("id", "row")).alias("places"))
    return materialise(chunks.join(places, "chunk").select("blob", "places").mapInArrow(tidied(_payload(text_col, of)), "id long, text binary"), name)


def verified(pairs: DataFrame, chunks: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(a, b) of the pairs (hub, other) whose texts are similar.

    A hub's text goes out once for each block of its partners, which hold about BLOCK_SHINGLES shingles in all;
    partners stream past it.
    """
    pairs = materialise(pairs, "near-pairs")
    ids = pairs.select(F.col("hub").alias("id")).union(pairs.select(F.col("other").alias("id"))).distinct()
    texts = payload(ids, _squeezed, "near-texts", chunks, nodes, text_col)
    sized = pairs.join(nodes.groupBy(F.col("id").alias("other")).agg(F.max("n").alias("n")), "other")
    blocks = sized.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    dealt = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("other"), "blocks").alias("block"), F.col("other").alias("id"))
    rows = dealt.withColumn("is_hub", F.lit(False)).union(dealt.select("hub", "block", F.col("hub").alias("id"), F.lit(True)).distinct())
    rows = rows.join(texts, "id").repartition("hub", "block").sortWithinPartitions("hub", "block", F.desc("is_hub"))

    def check(batches):
        import zstandard

        own = None
        for batch in batches:
            a, b = [], []
            for hub, id_, is_hub, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found, _ = labelled_shingles(Words([zstandard.ZstdDecompressor().decompress(blob)]))
                if is_hub:
                    own = found
                elif ordered_similarity(own, found) > 0:
                    a.append(max(hub, id_))
                    b.append(min(hub, id_))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("hub", "id", "is_hub", "text", "block").mapInArrow(tidied(check), "a long, b long")


def _cross_pairs(table: pa.Table) -> pa.Table:
    """Pairs of left and right rows in different components whose lengths and shingles allow it.

    A pair that shares several sketches is given in the first of their buckets only; in buckets of
    exact keys, only pairs that share no sketch are.
    """
    i = table.column("i")[0].as_py()
    side = np.asarray(table.column("left"))
    ids, label, n = (np.asarray(table.column(k)) for k in ("id", "label", "n"))
    sketches = np.asarray(table.column("sketches").combine_chunks().flatten()).reshape(len(ids), -1)
    thin = [np.frombuffer(t, np.uint32) for t in table.column("text").to_pylist()]
    bits = np.array([t[0] for t in thin])
    left, right = np.flatnonzero(side), np.flatnonzero(~side)
    values = np.concatenate([thin[y][1:] for y in right]) if len(right) else np.zeros(0, np.uint32)
    owner = np.repeat(right, [len(thin[y]) - 1 for y in right]) if len(right) else right
    out_a, out_b = [], []
    for x in left.tolist():
        ys = right[label[right] != label[x]]
        ys = ys[np.minimum(n[ys], n[x]) >= SIMILARITY * np.maximum(n[ys], n[x]) - 1e-9]
        same = sketches[ys] == sketches[x]
        ys = ys[same.any(axis=1) & (same.argmax(axis=1) == i)] if i < SKETCHES else ys[~same.any(axis=1)]
        for level in np.unique(np.maximum(bits[ys], bits[x])).tolist():
            mine = np.zeros(len(ids), dtype=bool)
            mine[ys[np.maximum(bits[ys], bits[x]) == level]] = True
            mask = np.uint32((1 << level) - 1)
            own = thin[x][1:][thin[x][1:] & mask == 0]
            use = mine[owner] & (values & mask == 0)
            sizes = np.bincount(owner[use], minlength=len(ids))
            both = np.bincount(owner[use][np.isin(values[use], own)], minlength=len(ids))
            union = sizes + len(own) - both
            # A sample's share strays from the text's: only where all shingles are there can it tell; others are aligned.
            hits = ids[mine & (both >= (SIMILARITY - 1e-9) * union)] if not level else ids[mine]
            out_a += [int(ids[x])] * len(hits)
            out_b += hits.tolist()
    return pa.Table.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["hub", "other"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, group): documents whose texts are near copies share the least id among them.

    Two texts are near copies if their ordered similarity on shingles of SHINGLE words is at
    least SIMILARITY (see ordered_similarity), and groups are connected by such pairs. Pairs are
    found if one of SKETCHES Order MinHash sketches (ORDERED least shingles each) is equal: at the
    threshold itself one of 25,000 pairs of 80 of 100 shingles is missed, above fewer. Of pairs of at
    most EXACT_SHINGLES shingles each none is missed (see exact_keys).

    Texts of the same words (by a cryptographic digest) are one node from the start. In each bucket of equal sketches all
    are first compared with its most connected member; where a bucket then still holds several
    components, its rows outside of that member's are compared with all of other components, in
    blocks of BLOCK_ROWS: by all shingles of texts of up to THINNED first, then by alignment. Every row gives one row.
    Rows without words (null, empty) or id are alone: group is the id. Rows of one id count as one document.
    """
    chunks = store_chunks(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), text_col, chunk_bytes)
    rows = materialise(chunks.mapInArrow(tidied(_nodes(id_col, text_col)), "id long, hi long, lo long, chunk long, row int, n int, sketches array<long>, exact array<long>"), "near-nodes")
    copies = rows.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    members = materialise(rows.select("id", "hi", "lo").join(copies, ["hi", "lo"]).select("id", "rep", "hi", "lo"), "near-members")
    nodes = materialise(rows.join(copies.withColumnRenamed("rep", "id"), ["id", "hi", "lo"]).dropDuplicates(["id", "hi", "lo"]), "near-distinct")

    sketched = nodes.select("id", F.posexplode("sketches").alias("i", "v"))
    sketched = sketched.union(nodes.select("id", F.lit(SKETCHES).alias("i"), F.explode("exact").alias("v")))
    shared = sketched.join(sketched.groupBy("i", "v").agg(F.count("*").alias("c")).where("c > 1"), ["i", "v"])
    shared = materialise(shared, "near-buckets")
    weight = shared.groupBy("id").agg(F.sum("c").alias("weight"))
    leaders = shared.join(weight, "id").groupBy("i", "v").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top"))
    leaders = leaders.select("i", "v", (-F.col("top.id")).alias("leader"))
    pairs = shared.join(leaders, ["i", "v"]).where("id <> leader").select(F.col("leader").alias("hub"), F.col("id").alias("other")).distinct()
    same_id = members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialise(verified(pairs, chunks, nodes, text_col).union(same_id), "near-links")
    labels = connected(links)

    labelled = shared.drop("c").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = labelled.groupBy("i", "v").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).where("x <> y")
    mixed = mixed.join(leaders, ["i", "v"]).join(labels, F.col("leader") == F.col("node"), "left").select("i", "v", "c", F.coalesce("label", "leader").alias("main"))
    apart = labelled.join(mixed, ["i", "v"]).withColumn("apart", F.col("label") != F.col("main"))
    sizes = apart.groupBy("i", "v").agg(F.ceil(F.max("c") / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.count_if("apart") / BLOCK_ROWS).cast("int").alias("left_blocks"))
    apart = materialise(apart.select("i", "v", "id", "label", "apart").join(sizes, ["i", "v"]), "near-apart")
    thin = payload(apart.select("id").distinct(), thinned, "near-thin", chunks, nodes, text_col)
    deal = F.xxhash64("id")
    rights = apart.select("*", F.lit(False).alias("left"), F.pmod(deal, "blocks").alias("r"), F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("l"))
    lefts = apart.where("apart").select("*", F.lit(True).alias("left"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r"), F.pmod(deal, "left_blocks").alias("l"))
    open_ = rights.unionByName(lefts).select("i", "v", "l", "r", "left", "id", "label").join(nodes.select("id", "n", "sketches"), "id").join(thin, "id")
    more = open_.groupBy("i", "v", "l", "r").applyInArrow(_cross_pairs, "hub long, other long").distinct()
    found = verified(more, chunks, nodes, text_col)
    links = materialise(links.union(found), "near-links")
    labels = connected(links)

    grouped = members.select("id").distinct().join(labels.withColumnRenamed("node", "id"), "id", "left")
    grouped = grouped.select(F.col("id").alias(id_col), F.coalesce("label", "id").alias("group"))
    every = docs.select(F.col(id_col).cast("long").alias(id_col))
    return every.join(grouped, id_col, "left").select(id_col, F.coalesce("group", F.col(id_col)).alias("group"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs, all columns, but for those whose group of near copies has a smaller id.

    Rows without an id, words or text are alone and stay; so do all rows of the id that stays.
    """
    key = F.col(id_col).cast("long")
    groups = near_duplicates(docs, id_col, text_col, chunk_bytes)
    gone = materialise(groups.where(F.col("group") < F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct(), "near-gone")
    return docs.join(gone, key == F.col("__gone"), "left_anti")


def op6_near_dups(spark, sf_dir: str) -> DataFrame:
    """The group of near copies of every document, and whether it is the one that stays."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("group").alias("group_id"), (F.col("doc_id") == F.col("group")).alias("keep"))

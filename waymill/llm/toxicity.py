"""Toxicity: a factorization machine over hashed terms, in NumPy."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import hash_share, remainder, tidied

HASH_BITS = 20
#: Rows of each label that the model is fitted on, at most about.
TRAIN_ROWS = 6_000
_WORD = re.compile(r"\w+")


def term_features(word: str) -> tuple[int, ...]:
    """Buckets of a lower-case word: itself and, of longer ones, its first 4 and 5 letters."""
    mask = (1 << HASH_BITS) - 1
    found = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) & mask]
    for n in (4, 5):
        if len(word) > n:
            found.append(zlib.crc32(b"p%d" % n + word[:n].encode("utf-8", "surrogatepass")) & mask)
    return tuple(found)


class Featuriser:
    """Sets of buckets of whole texts; remembers words, a bounded number of them."""

    def __init__(self, columns: np.ndarray | None = None, limit: int = 400_000):
        self.column = None if columns is None else {int(b): i for i, b in enumerate(columns)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.limit = limit

    def __call__(self, text: str | None) -> np.ndarray:
        known, out = self.known, set()
        for word in set(_WORD.findall((text or "").lower())):
            got = known.get(word)
            if got is None:
                got = term_features(word)
                if self.column is not None:
                    got = tuple(self.column[b] for b in got if b in self.column)
                if len(known) >= self.limit:
                    known.clear()
                known[word] = got
            if got:
                out.update(got)
        return np.fromiter(sorted(out), dtype=np.int32, count=len(out))


class FactorizationMachine:
    """p = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the present columns.

    Columns: the buckets whose share among positives differs from that among negatives by more
    than ``min_z`` standard errors, and those of pairs that, where both are present, go with a label
    beyond what a machine of the former columns says (see pair_columns), however even either is alone.
    Fitted by Adam on the logistic loss with L2.
    """

    def __init__(self, rank: int = 6, min_z: float = 4.0, epochs: int = 30, l2: float = 1e-4, seed: int = 7):
        self.rank, self.min_z, self.epochs, self.l2, self.seed = rank, min_z, epochs, l2, seed

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> FactorizationMachine:
        y = np.asarray(y, dtype=np.float64)
        n1, n0 = y.sum(), (1 - y).sum()
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if len(rows) else np.zeros(0, int)
        width = 1 << HASH_BITS
        positives = np.bincount(flat[y[owner] == 1], minlength=width)
        total = np.bincount(flat, minlength=width)
        with np.errstate(divide="ignore", invalid="ignore"):
            p1, p0, p = (positives + 0.5) / (n1 + 1), (total - positives + 0.5) / (n0 + 1), (total + 1) / (n1 + n0 + 2)
            z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1)))
        self.columns = np.flatnonzero((total >= 3) & (z >= self.min_z)) if n1 and n0 else np.zeros(0, int)
        gap = y - self._fit_columns(rows, y)
        if n1 and n0:
            more = pair_columns(rows, gap, self.columns)
            if len(more):
                self.columns = np.union1d(self.columns, more)
                self._fit_columns(rows, y)
        return self

    def _fit_columns(self, rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """Fit over ``columns``; the probabilities of the rows."""
        prior = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(prior / (1 - prior)))
        self.w = np.zeros(len(self.columns))
        rng = np.random.default_rng(self.seed)
        self.v = rng.normal(0, 0.01, (len(self.columns), self.rank))
        if not len(self.columns):
            return np.full(len(y), prior)
        place = np.full(1 << HASH_BITS, -1)
        place[self.columns] = np.arange(len(self.columns))
        sets = [place[r][place[r] >= 0] for r in rows]
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (np.zeros(1), self.w, self.v)]
        step = 0
        for _ in range(self.epochs):
            order = rng.permutation(len(sets))
            for part in np.array_split(order, max(1, len(order) // 256)):
                idx, who, score, sums = self._forward([sets[i] for i in part])
                gap = (1 / (1 + np.exp(-score)) - y[part]) / len(part)
                dw = np.bincount(idx, weights=gap[who], minlength=len(self.w)) + self.l2 * self.w
                dv = np.zeros_like(self.v)
                np.add.at(dv, idx, gap[who, None] * (sums[who] - self.v[idx]))
                dv += self.l2 * self.v
                step += 1
                bias = np.array([self.bias])
                for x, g, (m, s) in zip((bias, self.w, self.v), (np.array([gap.sum()]), dw, dv), state, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    x -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                self.bias = float(bias[0])
        return self.predict(sets)

    def _forward(self, sets: list[np.ndarray]):
        sizes = [len(s) for s in sets]
        idx = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(sets)), sizes)
        linear = np.bincount(who, weights=self.w[idx], minlength=len(sets))
        sums = np.stack([np.bincount(who, weights=self.v[idx, f], minlength=len(sets)) for f in range(self.rank)], axis=1)
        squares = np.bincount(who, weights=(self.v[idx] ** 2).sum(axis=1), minlength=len(sets))
        return idx, who, np.clip(self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), -30, 30), sums

    def predict(self, sets: list[np.ndarray]) -> np.ndarray:
        """Probabilities for sets of column numbers (a Featuriser over ``columns`` makes them)."""
        return 1 / (1 + np.exp(-self._forward(sets)[2])) if sets else np.zeros(0)


def pair_columns(rows: list[np.ndarray], gap: np.ndarray, known: np.ndarray, chance: float = 0.05) -> np.ndarray:
    """Buckets of pairs whose co-occurrence goes with a label beyond what is known, of which one at least isn't in ``known``.

    gap: label less probability by row. A pair counts if sum(gap) / sqrt(sum(gap^2)) over the rows that
    have both is so large that all pairs tested would show one such by chance only ``chance`` times.
    That takes as many rows as that bound squared at least, so rarer buckets are left out from the start. One
    bucket after another is paired with all others, so memory holds a row of the table of pairs at a time.
    """
    if not len(rows):
        return np.zeros(0, int)
    width = 1 << HASH_BITS
    total = np.bincount(np.concatenate(rows), minlength=width)
    tested = np.count_nonzero(total >= 20)
    least = np.sqrt(2 * np.log(max(tested, 2) ** 2 / 2 / chance))
    use = np.flatnonzero(total >= least**2)
    place = np.full(width, -1, dtype=np.int32)
    place[use] = np.arange(len(use))
    sets = [place[r][place[r] >= 0] for r in rows]
    sizes = np.array([len(s) for s in sets])
    flat, bounds = np.concatenate(sets), np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_term = np.argsort(flat, kind="stable")
    edges = np.searchsorted(flat[by_term], np.arange(len(use) + 1))
    old = np.isin(use, known)
    found = np.zeros(len(use), dtype=bool)
    for i in range(len(use)):
        mine = owner[by_term[edges[i] : edges[i + 1]]]
        g = gap[mine]
        others = np.concatenate([flat[bounds[r] : bounds[r + 1]] for r in mine.tolist()])
        weight = np.repeat(g, sizes[mine])
        sums, squares = np.bincount(others, weight, len(use)), np.bincount(others, weight * weight, len(use))
        hit = np.abs(sums) >= least * np.sqrt(squares)
        hit &= squares > 0
        hit[i] = False
        if old[i]:
            hit &= ~old
        if hit.any():
            found |= hit
            found[i] = True
    return use[found & ~old]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, **params) -> FactorizationMachine:
    """Fit on about ``train_rows`` labelled documents of either label, chosen by a hash of the id.

    The probabilities are those among all labels, however much of either is sampled.
    Labels other than 0 and 1, null ids and labels without a document are ignored. Repeated
    labels and documents count as often as they stand there, contradictory ones for both sides. Only the named
    columns of either table are read. With one label only, or none, as of empty tables, the model
    gives the smoothed share of label 1 to all texts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    shares = {y: min(1.0, train_rows / n) for y, n in counts.items()}
    keep = F.lit(False)
    for y, share in shares.items():
        keep = keep | ((F.col("y") == y) & hash_share("id", share))
    chosen = F.broadcast(known.where(keep))  # 2 * train_rows rows, about

    def featurise(batches):
        make = Featuriser()
        for batch in batches:
            sets = [make(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["id", "y", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select(F.col("id").cast("long").alias("id"), "y", "text")
    got = rows.mapInArrow(tidied(featurise), "id long, y int, x binary").toArrow()
    order = sorted(zip(got.column("id").to_pylist(), got.column("y").to_pylist(), got.column("x").to_pylist(), strict=True))
    model = FactorizationMachine(**params).fit([np.frombuffer(x, np.int32) for _, _, x in order], np.array([y for _, y, _ in order]))
    model.bias -= float(np.log(shares.get(1, 1.0) / shares.get(0, 1.0)))  # odds of the sample to odds of all labels
    return model


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score, the probability of label 1, of every whole text.

    A null text scores as an empty one, which has the probability of a text without any known term.
    Equal texts score alike. Every row gives one row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^HASH_BITS columns
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches):
        model = shared.value
        make = Featuriser(model.columns)
        for batch in batches:
            scores = model.predict([make(t.as_py()) for t in batch.column(batch.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tidied(run), schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents scored; fitted on labels whose remainder is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(remainder("doc_id", 3) != 1))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))

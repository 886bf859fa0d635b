"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import hash_share, mix, remainder, slices, tidied, U64

ORDER = 4
#: Characters of text that the models are fitted on, of all languages together, about.
TRAIN_CHARS = 6_000_000
#: Texts of a language that has as many, about, however long they are.
MIN_TEXTS = 50
_LIMIT = 0x110000
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point -> itself if a letter, else the space."""
    if not _FOLD:
        table = np.full(_LIMIT, 32, dtype=np.uint32)
        letters = np.array([c for c in range(_LIMIT) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()], dtype=np.uint32)
        table[letters] = letters
        _FOLD.append(table)
    return _FOLD[0]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of lower-case texts with one space for each run of anything else.

    Returns code points of all texts, each led by one space, the index of the text of
    each, and how many letters each text has.
    """
    lowered = [(t or "").lower() for t in texts]
    raw = " ".join(lowered) + " "
    codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    codes = np.r_[np.uint32(32), _fold_table()[codes][:-1]] if len(codes) else codes
    # The space that led text i is the one that ended text i - 1: shifting by one gives it to text i.
    letters = codes != 32
    keep = letters.copy()
    keep[1:] |= letters[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    keep |= first
    counts = np.bincount(owner[letters], minlength=len(texts)) if len(owner) else np.zeros(len(texts), int)
    return codes[keep], owner[keep], counts


def gram_keys(codes: np.ndarray, owner: np.ndarray, order: int) -> list[np.ndarray]:
    """keys[n - 1][i]: hash of the n characters that end at i; 0 where the text has not so many."""
    keys, rolled = [], np.zeros(len(codes), dtype=U64)
    wide = codes.astype(U64) + U64(1)
    for n in range(1, order + 1):
        if n == 1:
            rolled = wide.copy()
        else:
            rolled = np.r_[U64(0), rolled[:-1]] * U64(0x100000001B3) + wide
        key = mix(rolled + U64(n * 0x9E3779B97F4A7C15 % (1 << 64))) | U64(1)
        if n > 1:
            short = np.ones(len(codes), dtype=bool)
            if len(codes) >= n:
                short[n - 1 :] = owner[n - 1 :] != owner[: len(codes) - n + 1]
            key[short] = 0
        keys.append(key)
    return keys


class HashTable:
    """A sorted array of 64-bit keys with the first place of each range of leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(np.ceil(np.log2(len(keys) + 1))))
        self.starts = np.searchsorted(keys >> U64(64 - self.bits), np.arange((1 << self.bits) + 1).astype(U64)).astype(np.int64)
        self.most = int(np.diff(self.starts).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the keys; -1 where there is none."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        at = self.starts[wanted >> U64(64 - self.bits)]
        open_ = np.arange(len(wanted))
        for _ in range(self.most):
            inside = at < len(self.keys)
            open_, at = open_[inside], at[inside]
            found = self.keys[at]
            asked = wanted[open_]
            hit = found == asked
            out[open_[hit]] = at[hit]
            more = found < asked
            open_, at = open_[more], at[more] + 1
            if not len(open_):
                break
        return out


@dataclass
class LanguageModels:
    """p(c | h) for each language: absolute discounting, lower orders on continuation counts.

    tables[n - 1]: the n-grams seen in any language, with log2 p of the last character
    in ``logp``; contexts[n - 1]: those followed by something, with log2 of the weight
    that they leave to the order below in ``backoff``.
    """

    langs: list[str]
    order: int = ORDER
    tables: list[HashTable] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[HashTable] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    unseen: float = -16.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    sharpness: float = 0.1
    tolerance: float = 6.0

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits for each character, by text and language, and how many letters each text has."""
        codes, owner, letters = encode(texts)
        n_texts, n_langs = len(texts), len(self.langs)
        if not n_langs or not len(codes):
            return np.zeros((n_texts, n_langs)), letters
        keys = gram_keys(codes, owner, self.order)
        scored = np.ones(len(codes), dtype=bool)
        scored[np.r_[True, owner[1:] != owner[:-1]]] = False  # the leading space is given
        sums = np.zeros((n_texts, n_langs))
        pending = np.flatnonzero(scored)
        for n in range(self.order, 0, -1):
            wanted = keys[n - 1][pending]
            place = self.tables[n - 1].find(wanted)
            hit = place >= 0
            who, rows = owner[pending[hit]], self.logp[n - 1][place[hit]]
            for j in range(n_langs):
                sums[:, j] += np.bincount(who, weights=rows[:, j], minlength=n_texts)
            pending = pending[~hit]
            if n > 1 and len(pending):
                back = self.contexts[n - 2].find(keys[n - 2][pending - 1])
                known = back >= 0
                who, rows = owner[pending[known]], self.backoff[n - 2][back[known]]
                for j in range(n_langs):
                    sums[:, j] += np.bincount(who, weights=rows[:, j], minlength=n_texts)
        sums += np.bincount(owner[pending], minlength=n_texts)[:, None] * self.unseen
        total = np.bincount(owner[scored], minlength=n_texts)
        return -sums / np.maximum(total, 1)[:, None], letters

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language (und: no letter), score, bits for each character, and whether it is accepted."""
        bits, letters = self.entropies(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        weigh = letters[:, None] * self.sharpness
        score = 1 / np.exp(np.clip((least[:, None] - bits) * weigh, -60, 0)).sum(axis=1)
        has = letters > 0
        limit = self.centre[best] + self.tolerance * self.spread[best] / np.sqrt(np.maximum(letters, 1)) if self.centre is not None else np.full(len(texts), np.inf)
        langs = [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
        return langs, np.where(has, score, 0.0), np.where(has, least, 0.0), has & (least <= limit)


def fit_models(samples: dict[str, list[str]], order: int = ORDER) -> LanguageModels:
    """Fit on texts by language; every fifth text (by place) calibrates rejection and score.

    A text is rejected if its bits for each character exceed the mean of its language
    by more than z spreads / sqrt(letters), z beyond all but the worst of 1,000
    calibration texts, and half a bit.
    """
    langs = sorted(samples)
    model = LanguageModels(langs, order)
    held = {lang: texts[::5] if len(texts) >= 10 else [] for lang, texts in samples.items()}
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by order, by language: keys, counts
    links: list[dict] = [{} for _ in range(order)]
    for lang in langs:
        texts = [t for i, t in enumerate(samples[lang]) if i % 5 or not held[lang]]
        codes, owner, _ = encode(texts)
        keys = gram_keys(codes, owner, order) if len(codes) else [np.zeros(0, U64)] * order
        lead = np.r_[True, owner[1:] != owner[:-1]] if len(codes) else np.zeros(0, bool)
        for n in range(order):
            at = np.flatnonzero((keys[n] != 0) & ~lead) if n == 0 else np.flatnonzero(keys[n] != 0)
            uniq, first, count = np.unique(keys[n][at], return_index=True, return_counts=True)
            end = at[first]
            links[n][lang] = {"key": uniq, "count": count.astype(np.float64), "suffix": keys[n - 1][end] if n else None, "context": keys[n - 1][end - 1] if n else None}
    del counts
    for n in range(order - 1):  # below the top, count the distinct characters that come before
        for lang in langs:
            low, high = links[n][lang], links[n + 1][lang]
            more = np.zeros(len(low["key"]))
            place = np.searchsorted(low["key"], high["suffix"])
            place = np.minimum(place, max(len(low["key"]) - 1, 0))
            if len(low["key"]):
                ok = low["key"][place] == high["suffix"]
                np.add.at(more, place[ok], 1)
            low["count"] = np.maximum(more, 1.0)
    vocabulary = max(2, len(np.unique(np.concatenate([links[0][x]["key"] for x in langs])))) if langs else 2
    model.unseen = -float(np.log2(vocabulary * 64))
    previous: tuple[HashTable, np.ndarray] | None = None
    for n in range(order):
        union = np.unique(np.concatenate([links[n][x]["key"] for x in langs])) if langs else np.zeros(0, U64)
        table = HashTable(union)
        logp = np.zeros((len(union), len(langs)), dtype=np.float32)
        suffix, context = np.zeros(len(union), dtype=U64), np.zeros(len(union), dtype=U64)
        for lang in langs:
            if n:
                place = np.searchsorted(union, links[n][lang]["key"])
                suffix[place], context[place] = links[n][lang]["suffix"], links[n][lang]["context"]
        ctx_union = np.unique(context) if n else np.zeros(0, U64)
        backoff = np.zeros((len(ctx_union), len(langs)), dtype=np.float32)
        for j, lang in enumerate(langs):
            own = links[n][lang]
            c = np.zeros(len(union))
            c[np.searchsorted(union, own["key"])] = own["count"]
            ones, twos = (own["count"] == 1).sum(), (own["count"] == 2).sum()
            discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))
            if n == 0:
                total = max(c.sum(), 1.0)
                free = discount * (c > 0).sum() / total if c.sum() else 1.0
                p = np.maximum(c - discount, 0) / total + free / vocabulary
            else:
                ctx = np.searchsorted(ctx_union, context)
                total = np.bincount(ctx, weights=c, minlength=len(ctx_union))
                kinds = np.bincount(ctx, weights=(c > 0).astype(float), minlength=len(ctx_union))
                with np.errstate(divide="ignore", invalid="ignore"):
                    free = np.where(total > 0, discount * kinds / total, 1.0)
                    share = np.where(total[ctx] > 0, np.maximum(c - discount, 0) / total[ctx], 0.0)
                low = previous[0].find(suffix)
                below = np.where(low >= 0, np.exp2(previous[1][np.maximum(low, 0), j].astype(np.float64)), 2.0**model.unseen)
                p = share + free[ctx] * below
                backoff[:, j] = np.log2(free)
            logp[:, j] = np.log2(np.maximum(p, 2.0**model.unseen))
        model.tables.append(table)
        model.logp.append(logp)
        if n:
            model.contexts.append(HashTable(ctx_union))
            model.backoff.append(backoff)
        previous = (table, logp)
    model.contexts.append(HashTable(np.zeros(0, U64)))
    model.backoff.append(np.zeros((0, len(langs)), np.float32))
    _calibrate(model, held, samples)
    return model


def _calibrate(model: LanguageModels, held: dict[str, list[str]], samples: dict[str, list[str]]) -> None:
    centre, spread, z, margins = [], [], [], []
    for j, lang in enumerate(model.langs):
        bits, letters = model.entropies(held[lang] or samples[lang])
        ok = letters > 0
        own, n = bits[ok, j], letters[ok]
        if not len(own):
            centre.append(np.inf)
            spread.append(1.0)
            continue
        mean = float(np.average(own, weights=n))
        scale = float(np.sqrt(np.mean(n * (own - mean) ** 2)) + 1e-3)
        centre.append(mean + 0.5)
        spread.append(scale)
        z.append((own - mean) * np.sqrt(n) / scale)
        others = np.delete(bits[ok], j, axis=1)
        if others.shape[1]:
            margins.append((others.min(axis=1) - own) * n)
    model.centre, model.spread = np.array(centre), np.array(spread)
    if z:
        model.tolerance = max(6.0, float(np.quantile(np.concatenate(z), 0.999)))
    if margins:  # the scale at which the scores of calibration texts have the least log loss
        m = np.concatenate(margins)
        scales = 2.0 ** np.arange(-8, 2)
        model.sharpness = float(scales[np.argmin([np.log1p(np.exp(np.clip(-m * s, -60, 60))).mean() for s in scales])])


def _even_cap(sizes: list[int], budget: int) -> int:
    """The most that each may give so that all together give the budget, about; no less than 1."""
    left, cap = budget, 0
    for i, size in enumerate(sorted(sizes)):
        cap = left // (len(sizes) - i)
        if size > cap:
            break
        left -= size
        cap = size
    return max(1, cap)


def sample_texts(labelled: DataFrame, train_chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Labelled texts of about train_chars in all, as much of each language, chosen by a hash of the id; at least one of each language.

    Texts are whole, unless a language's are so long that fewer than MIN_TEXTS are its share of
    the characters: then it has about MIN_TEXTS texts (all, if it has no more), and the longest lend a stretch.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    totals = {r.lang: (r.chars, r.n) for r in known.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).collect()}
    budget = max(1, train_chars // max(1, len(totals)))
    shares = {lang: min(1.0, max(budget / max(chars, 1), MIN_TEXTS / n)) for lang, (chars, n) in totals.items()}
    keep, long = F.lit(False), [lang for lang, (chars, _) in totals.items() if shares[lang] > budget / max(chars, 1)]
    for lang, share in shares.items():
        keep = keep | ((F.col("lang") == lang) & hash_share("id", share))
    chosen = known.where(keep)
    if long:  # a bounded number of texts each, unless ids are repeated
        sizes: dict[str, list[int]] = {}
        for r in chosen.where(F.col("lang").isin(long)).groupBy("lang", F.length("text").alias("size")).agg(F.count("*").alias("c")).collect():
            sizes.setdefault(r.lang, []).extend([r.size] * r.c)
        cap = F.lit(None).cast("int")
        for lang, own in sizes.items():
            cap = F.when(F.col("lang") == lang, min(_even_cap(own, budget), 2**31 - 1)).otherwise(cap)
        chosen = chosen.withColumn("text", _stretch(cap))
    got = chosen.toArrow()
    rows = list(zip(got.column("id").to_pylist(), got.column("text").to_pylist(), got.column("lang").to_pylist(), strict=True))
    missing = sorted(set(totals) - {lang for _, _, lang in rows})
    if missing:  # only where many rows share few ids: the text of the least hash
        first = known.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by(F.struct("id", _stretch(F.lit(min(budget, 2**31 - 1))).alias("text")), F.struct(F.xxhash64("id"), F.xxhash64("text"))).alias("r"))
        rows += [(r.r.id, r.r.text, r.lang) for r in first.collect()]
    out: dict[str, list[str]] = {}
    for _, text, lang in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(lang, []).append(text)
    return out


def _stretch(cap: Column) -> Column:
    """cap characters of the text from a place chosen by the id's hash; all of it if it has no more or cap is null."""
    spare = F.length("text") - cap
    start = F.when(spare > 0, F.pmod(F.xxhash64("id"), spare + 1).cast("int") + 1).otherwise(1)
    return F.substring("text", start, F.coalesce(cap, F.length("text")))


def identify(docs: DataFrame, model: LanguageModels, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and lang_pred, score, bits, accepted for every whole text.

    lang_pred: the language of least bits for each character; ``und`` if the text is null
    or has no letter (score and bits 0, not accepted) or nothing was learned. score: the
    calibrated share of the best language, 0 to 1. accepted: false for und and where even
    the best model is surprised beyond what calibration texts show. Ties go to the first
    language by name. Every row gives one row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("bits", "double").add("accepted", "boolean")

    def run(batches):
        model = shared.value
        for batch in slices(batches, "__text"):
            langs, score, bits, accepted = model.judge(batch.column(batch.num_columns - 1).to_pylist())
            new = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tidied(run), schema)


def drop_rejected(docs: DataFrame, model: LanguageModels, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text the models accept (see identify).

    Null texts and those without a letter aren't accepted; equal texts are judged alike; if nothing was learned, no row stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches, text_col):
            accepted = model.judge(batch.column(batch.schema.get_field_index(text_col)).to_pylist())[3]
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def train_on_documents(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> LanguageModels:
    """Models from text and non-null lang of the documents whose crc32 remainder by 4 is not 2."""
    return fit_models(sample_texts(docs.where(remainder("doc_id", 4) != 2), train_chars))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return identify(docs, train_on_documents(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits", "accepted")

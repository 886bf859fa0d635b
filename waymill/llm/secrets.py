"""Secret scans: fixed rules, and a character convolutional network over every other candidate."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import hash_share, slices, tidied

KINDS = ("assign", "access", "hex", "learned")
#: Documents whose text lends its surroundings to the training findings, about.
CONTEXT_DOCS = 2_000
#: Findings that are made for training and, beside these, for calibration.
TRAIN_FINDINGS, HELD_FINDINGS = 4_000, 2_000
#: Documents whose findings by the rules are labelled findings, about, and how many of these train and calibrate at most.
FINDING_DOCS, RULE_FINDINGS = 20_000, 2_000
#: Share of held-out secrets of each shape that must be found.
RECALL = 0.97
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the rules, leftmost and non-overlapping for each kind, in the order of start, then kind.

    A failing match still takes its stretch. For access and hex a match is a whole run from
    its first fitting place, so a shorter run fails as a whole and the length can be part of the pattern.
    """
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def candidates(text: str, known: list[tuple[str, int, int]] = ()) -> list[tuple[int, int]]:
    """Runs of 16 or more characters of keys and encodings, but for those that lie wholly within known spans (ordered by start)."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in known:  # joined where they meet
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    found, at = [], 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(ends) and ends[at] <= a:
            at += 1
        if at == len(ends) or starts[at] > a or ends[at] < b:
            found.append((a, b))
    return found


def shape(token: str) -> str:
    """What a candidate is made of; each shape has its own threshold."""
    if token.isdigit():
        return "digits"
    if token.isalpha():
        return "letters" if token[1:] == token[1:].lower() else "mixed letters"
    if not set(token.lower()) - set("0123456789abcdef-"):
        return "hex"
    if token.upper() == token or token.lower() == token:
        return "one case"
    return "mixed"


# The network sees LEFT characters before MIDDLE of a candidate and RIGHT after it; over longer ones it moves by STEP.
LEFT, MIDDLE, RIGHT, STEP = 32, 64, 16, 32
_LENGTH = LEFT + MIDDLE + RIGHT
_CODES = np.full(0x110000, 97, dtype=np.int64)
_CODES[32:127] = np.arange(1, 96)
_CODES[[9, 10, 13]] = 96
_ALPHABET = 98


def pieces(a: int, b: int) -> list[tuple[int, int]]:
    """Stretches of MIDDLE characters that cover a candidate, each STEP from the one before, the last at its end."""
    if b - a <= MIDDLE:
        return [(a, b)]
    return [(i, i + MIDDLE) for i in [*range(a, b - MIDDLE, STEP), b - MIDDLE]]


def encode(texts: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
    """Character classes by stretch of at most MIDDLE characters; 0 where there is nothing."""
    rows = []
    for text, (a, b) in zip(texts, spans, strict=True):
        rows.append(text[max(0, a - LEFT) : a].rjust(LEFT, "\0") + text[a:b].ljust(MIDDLE, "\0") + text[b : b + RIGHT].ljust(RIGHT, "\0"))
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(rows), _LENGTH)
    return np.where(codes == 0, 0, _CODES[codes])


def encode_whole(texts: list[str], spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all stretches of the candidates, and the candidate of each."""
    parts = [pieces(a, b) for a, b in spans]
    owner = np.repeat(np.arange(len(spans)), [len(p) for p in parts])
    return encode([texts[i] for i in owner.tolist()], [p for of in parts for p in of]), owner


@dataclass
class CharCNN:
    """Embedded characters, one convolution, maxima and means of three segments, a logistic unit; fitted by Adam."""

    width: int = 5
    channels: int = 8
    filters: int = 24
    seed: int = 11
    params: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def _pools(self) -> list[slice]:
        reach = self.width - 1
        return [slice(0, LEFT), slice(LEFT, LEFT + MIDDLE - reach), slice(LEFT + MIDDLE - reach, _LENGTH - reach)]

    def _forward(self, codes: np.ndarray):
        p = self.params
        x = p["embed"][codes]
        x = x + p["place"][None]
        col = np.lib.stride_tricks.sliding_window_view(x, self.width, axis=1).reshape(len(codes), _LENGTH - self.width + 1, -1)
        z = col @ p["conv"] + p["bias"]
        act = np.maximum(z, 0)
        pooled, tops = [], []
        for s in self._pools():
            top = act[:, s].argmax(axis=1)
            tops.append(top)
            pooled += [np.take_along_axis(act[:, s], top[:, None], axis=1)[:, 0], act[:, s].mean(axis=1)]
        features = np.concatenate(pooled, axis=1)
        return features @ p["out"] + p["shift"], (col, z, features, tops)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[a : a + 512])[0] for a in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def fit(self, codes: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.004) -> CharCNN:
        rng = np.random.default_rng(self.seed)
        taps = self.width * self.channels
        self.params = {
            "embed": rng.normal(0, 0.5, (_ALPHABET, self.channels)),
            "place": np.zeros((_LENGTH, self.channels)),
            "conv": rng.normal(0, taps**-0.5, (taps, self.filters)),
            "bias": np.zeros(self.filters),
            "out": rng.normal(0, 0.1, 6 * self.filters),
            "shift": np.zeros(1),
        }
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.params.items()}
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                step += 1
                for k, g in self._gradient(codes[at], y[at]).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.params[k] = self.params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, len(y)
        score, (col, z, features, tops) = self._forward(codes)
        gap = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / n
        back = gap[:, None] * p["out"][None]
        d_act = np.zeros_like(z)
        for k, (s, top) in enumerate(zip(self._pools(), tops, strict=True)):
            most, mean = (back[:, (2 * k + i) * self.filters : (2 * k + i + 1) * self.filters] for i in (0, 1))
            part = d_act[:, s]
            part += mean[:, None] / part.shape[1]
            np.put_along_axis(part, top[:, None], np.take_along_axis(part, top[:, None], axis=1) + most[:, None], axis=1)
        d_z = d_act * (z > 0)
        flat = d_z.reshape(-1, self.filters)
        d_col = (flat @ p["conv"].T).reshape(n, z.shape[1], self.channels, self.width)
        d_x = np.zeros((n, _LENGTH, self.channels))
        for w in range(self.width):
            d_x[:, w : w + z.shape[1]] += d_col[..., w]
        d_embed = np.zeros_like(p["embed"])
        np.add.at(d_embed, codes.ravel(), d_x.reshape(-1, self.channels))
        return {
            "embed": d_embed + 1e-5 * p["embed"],
            "place": d_x.sum(axis=0) + 1e-5 * p["place"],
            "conv": col.reshape(-1, col.shape[2]).T @ flat + 1e-5 * p["conv"],
            "bias": flat.sum(axis=0),
            "out": features.T @ gap + 1e-4 * p["out"],
            "shift": np.array([gap.sum()]),
        }

    def calibrate(self, texts: list[str], spans: list[tuple[int, int]], y: np.ndarray, recall: float = RECALL) -> CharCNN:
        """Platt scaling on held-out findings; for each shape the highest threshold that keeps ``recall``.

        A shape without held-out secrets has threshold 2: none of it is reported.
        """
        codes, owner = encode_whole(texts, spans)
        s = np.full(len(spans), -np.inf)
        np.maximum.at(s, owner, self.logits(codes))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - y) * s).sum() + 0.01 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * s * s).sum() + 0.01, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        self.scale = (float(a), float(b))
        p, kinds = self.probability(texts, spans), np.array([shape(t[i:j]) for t, (i, j) in zip(texts, spans, strict=True)])
        for kind in sorted(set(kinds)):
            own = np.sort(p[(kinds == kind) & (y == 1)])
            self.thresholds[kind] = float(own[int((1 - recall) * len(own))]) if len(own) >= 20 else 2.0
        return self

    def probability(self, texts: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
        """Of each candidate (text, span): that of its likeliest stretch."""
        out = np.zeros(len(spans))
        a, b = self.scale
        for at in range(0, len(spans), 1024):
            codes, owner = encode_whole(texts[at : at + 1024], spans[at : at + 1024])
            np.maximum.at(out, at + owner, 1 / (1 + np.exp(-np.clip(a * self.logits(codes) + b, -30, 30))))
        return out


_ALNUM, _B64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
# Shapes of keys: prefix, alphabet, lengths.
_SECRETS = (
    ("", "0123456789abcdef", (32, 40, 48, 64)),
    ("", _ALNUM, (20, 24, 32, 40, 48)),
    ("", _B64, (40, 44, 64, 88)),
    ("", _ALNUM + "_-", (32, 43, 64)),
    ("AKIA", string.ascii_uppercase + string.digits, (16,)),
    ("ghp_", _ALNUM, (36,)),
    ("sk_live_", _ALNUM, (24, 32)),
    ("sk-", _ALNUM, (32, 48)),
    ("xoxb-", string.digits + "-" + _ALNUM, (40, 52)),
    ("AIza", _ALNUM + "_-", (35,)),
    ("eyJ", _ALNUM + "_-", (40, 80, 120)),
    ("", string.ascii_letters, (20, 24, 32, 40)),
    ("", string.ascii_lowercase, (16, 20, 32)),
    ("", string.ascii_uppercase, (20, 32)),
)
_LEADS = ('token = "', "token: ", 'secret="', "API_KEY=", "password: ", "api key ", 'Authorization: Bearer ', "export KEY=", '"key": "', "--key ", "credentials ", "", "", " ")
_DULL_LEADS = ("commit ", "sha256:", "md5 ", "id ", "file ", "see ", "order ", "build ", "", "", " ", "/static/", "version ")


def made_findings(contexts: list[str], n: int, seed: int) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """Labelled findings: n texts with a secret (1) or a token that looks like one (0), amid the given surroundings."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    own = [w for c in contexts for w in re.findall(r"[A-Za-z]{2,}", c[1:-1])] or ["the", "and", "ing", "der", "lich", "ent"]
    word = lambda: "".join(pick("bcdfghlmnprstvw") + pick("aeiou") for _ in range(int(rng.integers(2, 5))))


    def joined(by: str, size: int) -> str:
        out = pick(own).lower()
        while len(out) < size:
            out += by + pick(own).lower()
        return out

    dull = (
        lambda: "_".join(word() for _ in range(3)) + f"_{rng.integers(1, 999)}",
        lambda: "-".join(word() for _ in range(4)) + f"-{rng.integers(2000, 2030)}",
        lambda: "".join(word().title() for _ in range(4)) + str(rng.integers(1, 99)),
        lambda: "/".join(word() for _ in range(3)) + f"/v{rng.integers(1, 9)}/" + word(),
        lambda: f"{rng.integers(2000, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(10**5, 10**6)}",
        lambda: "".join(str(rng.integers(10)) for _ in range(int(rng.integers(16, 22)))),
        lambda: pick("abx0-=_") * int(rng.integers(12, 40)) + "1234",
        lambda: f"IMG_{rng.integers(10**7, 10**8)}_{rng.integers(10**5, 10**6)}",
        lambda: "-".join("".join(pick("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)),
        lambda: "".join(pick("0123456789abcdef") for _ in range(int(pick((32, 40, 64))))),
        lambda: word().upper() + "_" + word().upper() + f"_{rng.integers(10, 99)}_" + word().upper(),
        lambda: joined("", 16),
        lambda: joined("", 16).capitalize(),
        lambda: joined("", 16).upper(),
        lambda: joined(pick("-_/"), 16),
        lambda: joined("/", int(rng.integers(40, 140))),
        lambda: "".join(w.title() for w in joined(" ", 16).split()) + pick(own).title(),
        lambda: pick("-=_+/") * int(rng.integers(16, 80)),
        lambda: word() + word() + word() + word(),
    )
    texts, spans, y = [], [], np.arange(n) % 2
    for label in y:
        around = pick(contexts) if contexts else ""
        cut = int(rng.integers(len(around) + 1))
        if label:
            prefix, alphabet, sizes = pick(_SECRETS)
            body = "".join(alphabet[i] for i in rng.integers(len(alphabet), size=int(pick(sizes))))
            token, lead = prefix + body, pick(_LEADS)
        else:
            kind = int(rng.integers(len(dull)))
            token = dull[kind]()
            lead = pick(_DULL_LEADS[:4]) if kind in (8, 9) else pick(_DULL_LEADS + _LEADS[-3:])
        before = around[:cut] + (" " if cut else "") + lead
        texts.append(before + token + ('"' if lead.endswith('"') else "") + " " + around[cut:])
        spans.append((len(before), len(before) + len(token)))
    return texts, spans, y.astype(np.float64)


def fit_scanner(texts: list[str], spans: list[tuple[int, int]], y: np.ndarray, held: tuple[list[str], list[tuple[int, int]], np.ndarray], recall: float = RECALL) -> CharCNN:
    """A network fitted on labelled findings and calibrated on others: texts, spans of the candidates, labels."""
    codes, owner = encode_whole(texts, spans)
    return CharCNN().fit(codes, y[owner]).calibrate(*held, recall)


def surroundings(docs: DataFrame, context_docs: int = CONTEXT_DOCS, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Stretches of 100 characters of about ``context_docs`` documents, chosen by a hash of the id, from places all over the texts."""
    place = F.pmod(F.xxhash64(id_col, text_col), F.greatest(F.length(text_col), F.lit(1))).cast("int")
    rows = docs.where(hash_share(id_col, context_docs / max(1, docs.count()))).select(F.substring(text_col, place, F.lit(100)).alias("t")).where("t <> ''")
    return sorted(r.t for r in rows.collect())


def rule_findings(docs: DataFrame, finding_docs: int = FINDING_DOCS, most: int = RULE_FINDINGS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[tuple[int, int]]]:
    """Findings of about ``finding_docs`` documents that the rules label as secrets: the value of an assignment or an access key, amid its text.

    Documents are chosen by a hash of the id; of more than ``most`` findings those of the least hash are taken.
    """
    chosen = docs.where(hash_share(id_col, finding_docs / max(1, docs.count()))).select(F.col(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                low = (text or "").lower()
                if any(w in low for w in _ASSIGN_WORDS) or "AKIA" in (text or ""):
                    values = [m.span(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 16] + [m.span() for m in _ACCESS.finditer(text)]
                    for a, b in values:
                        start = max(0, a - LEFT)
                        out.append((text[start : b + RIGHT], a - start, b - start))
            yield pa.RecordBatch.from_pydict({"t": pa.array([x[0] for x in out], pa.string()), "a": pa.array([x[1] for x in out], pa.int32()), "b": pa.array([x[2] for x in out], pa.int32())})

    found = chosen.mapInArrow(tidied(run), "t string, a int, b int").where("length(t) < 4096").orderBy(F.xxhash64("t", "a"), "t", "a").limit(most).collect()
    return [r.t for r in found], [(r.a, r.b) for r in found]


def train_scanner(docs: DataFrame, **columns) -> CharCNN:
    """The production network: half of the rules' findings in the documents and made ones for training, the rest for calibration."""
    contexts = surroundings(docs, **columns)
    texts, spans = rule_findings(docs, **columns)
    sets = []
    for half, n in enumerate((TRAIN_FINDINGS, HELD_FINDINGS)):
        made, where, y = made_findings(contexts, n, half + 1)
        sets.append((made + texts[half::2], where + spans[half::2], np.r_[y, np.ones(len(texts[half::2]))]))
    return fit_scanner(*sets[0], sets[1])


def find_secrets(docs: DataFrame, model: CharCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and spans (kind, start, end, score) of every whole text, in the order of start, then kind.

    All spans of the rules stay, with score 1. A candidate, of any length, that isn't wholly within
    them is added as ``learned`` if its calibrated probability, that of its likeliest stretch, reaches the
    threshold of its shape.
    Positions count code points, the end is exclusive. Null or empty text: no spans. Every
    row gives one row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        model = shared.value
        for batch in slices(batches, "__text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, owner, where = [], [], []
            for r, text in enumerate(texts):
                base = base_spans(text)
                found.append([(a, KINDS.index(k), b, 1.0) for k, a, b in base])
                for span in candidates(text, base):
                    owner.append(r)
                    where.append(span)
            for r, (a, b), p in zip(owner, where, model.probability([texts[r] for r in owner], where).tolist(), strict=True):
                if p >= model.thresholds.get(shape(texts[r][a:b]), 2.0):
                    found[r].append((a, 3, b, p))
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, k, b, p in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=[id_col, "spans"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text")).mapInArrow(tidied(run), f"`{id_col}` long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts and digest of what the rules find, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find_secrets(docs, train_scanner(docs))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, label), ",")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "learned")), 256)
    return out.select("doc_id", *counts[:3], base.alias("base_sha256"), joined("spans").alias("spans"), counts[3])

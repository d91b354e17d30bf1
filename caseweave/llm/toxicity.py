"""Toxic spans by a linear-chain conditional random field, aggregated to document scores."""
from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIP = b".,;:!?\"'()[]{}<>|/\\#$%&*+-=_~^`"
#: Log-odds at which a word starts to be a feature, and the further borders of the feature bins.
BORDERS = (1.5, 2.5, 3.5)
#: Different neighbourhoods that a word needs in toxic texts; copies of one text show a word in one neighbourhood only.
SUPPORT = (3, 8)
KINDS = 1 + len(BORDERS) * len(SUPPORT)
REACH = 5
CACHE = 400_000


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes without ASCII white space, A-Z lower-cased."""
    return text.lower().split()


@dataclass
class Model:
    """kinds: feature bin of each word that is one; emission and transition: CRF weights; document: logistic weights."""
    kinds: dict[bytes, int] = field(default_factory=dict)
    emission: np.ndarray = field(default_factory=lambda: np.zeros(3 * KINDS))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(5))


def number_words(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text as numbers of its words without the signs around them, and the words by number."""
    numbers: dict[bytes, int] = {}
    raw: dict[bytes, int] = {}
    out = []
    for text in texts:
        row = []
        for word in words_of(text):
            n = raw.get(word)
            if n is None:
                n = raw[word] = numbers.setdefault(word.strip(STRIP), len(numbers))
            row.append(n)
        out.append(np.array(row, np.int32))
    return out, list(numbers)


def word_kinds(texts: list[np.ndarray], toxic: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Feature bin of each word (0: none) for standing in toxic texts, by smoothed log-odds and by support."""
    seen = np.zeros((2, len(words)), np.int64)
    for text, label in zip(texts, toxic):
        seen[int(label), np.unique(text)] += 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    level = sum((odds >= b).astype(int) for b in BORDERS)
    open_ = (seen[1] > 0) & (level > 0) & np.array([bool(w) for w in words], bool)
    around: dict[int, set] = defaultdict(set)
    for text, label in zip(texts, toxic):
        if label:
            for p in np.flatnonzero(open_[text]):
                around[int(text[p])].add((int(text[p - 1]) if p else -1, int(text[p + 1]) if p + 1 < len(text) else -1))
    kinds = np.zeros(len(words), np.int8)
    for word, neighbours in around.items():
        support = sum(len(neighbours) >= s for s in SUPPORT)
        if support:
            kinds[word] = 1 + (support - 1) * len(BORDERS) + level[word] - 1
    return kinds


class Tagger:
    """Marginals of the toxic state. Tokens without a feature share one emission, so a run of them is a matrix power."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}
        self.step = np.exp(model.transition)
        self.neutral = np.array([1.0, math.exp(self.weight(0, 0, 0))])
        self.through = self.step * self.neutral[None]
        values, vectors = np.linalg.eig(self.through)
        by = np.argsort(-np.abs(values))
        self.top = float(values[by[0]].real)
        self.ratio, self.vectors = float((values[by[1]] / values[by[0]]).real), vectors[:, by].real
        self.inverse = np.linalg.inv(self.vectors)

    def weight(self, here: int, before: int, after: int) -> float:
        e = self.model.emission
        return float(e[here] + e[KINDS + before] + e[2 * KINDS + after])

    def power(self, n: int) -> np.ndarray:
        """`through` to the n, up to a positive factor."""
        return (self.vectors * np.array([1.0, self.ratio ** n])) @ self.inverse if n else np.eye(2)

    def kinds(self, words: list[bytes]) -> np.ndarray:
        known, cache = self.model.kinds, self.cache
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for w in words:
            k = cache.get(w)
            if k is None:
                k = known.get(w.strip(STRIP), 0)
                if len(w) < 64:
                    cache[w] = k
            out.append(k)
        return np.array(out, np.int8)

    def marginals(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, probabilities) of the tokens that have a feature or stand next to one; forward-backward over all."""
        hits = np.flatnonzero(kind)
        if not len(hits):
            return hits, np.zeros(0)
        at = np.unique(np.concatenate([hits - 1, hits, hits + 1]))
        at = at[(at >= 0) & (at < len(kind))]
        phi = [np.array([1.0, math.exp(self.weight(int(kind[p]), int(kind[p - 1]) if p else 0,
                                                   int(kind[p + 1]) if p + 1 < len(kind) else 0))]) for p in at]
        gaps = np.diff(at) - 1
        forward = []
        for n, p in enumerate(at):
            if n:
                a = forward[-1] @ self.power(int(gaps[n - 1])) @ self.step * phi[n]
            elif p:
                a = self.neutral @ self.power(int(p) - 1) @ self.step * phi[0]
            else:
                a = phi[0]
            forward.append(a / a.sum())
        back = self.power(len(kind) - 1 - int(at[-1])) @ np.ones(2)
        out = np.empty(len(at))
        for n in range(len(at) - 1, -1, -1):
            joint = forward[n] * back
            out[n] = joint[1] / joint.sum()
            if n:
                back = self.power(int(gaps[n - 1])) @ (self.step @ (phi[n] * back))
                back /= back.sum()
        return at, np.clip(out, 0.0, 1.0)

    def features(self, words: list[bytes], probability: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Aggregates of a document: largest marginal, expected toxic tokens, different toxic words, and their share."""
        if not len(at):
            return np.array([1.0, 0.0, 0.0, 0.0, 0.0])
        total = float(probability.sum())
        likely = {words[p].strip(STRIP) for p, m in zip(at, probability) if m >= 0.5}
        return np.array([1.0, float(probability.max()), math.log1p(total), math.log1p(len(likely)), math.log1p(50 * total / len(words))])

    def score(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and the byte spans (start, end, probability) of its tokens that are likely toxic."""
        words = words_of(text)
        kind = self.kinds(words)
        at, probability = self.marginals(kind)
        value = self.features(words, probability, at) @ self.model.document
        spans, place = [], 0
        lowered = text.lower() if len(at) else b""
        n, likely = 0, {int(p): float(m) for p, m in zip(at, probability) if m >= 0.5}
        last = max(likely, default=-1)
        while n <= last:
            place = lowered.index(words[n], place)
            if n in likely:
                spans.append((place, place + len(words[n]), likely[n]))
            place += len(words[n])
            n += 1
        return 1 / (1 + math.exp(-float(np.clip(value, -30, 30)))), spans


def _windows(kinds: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled token windows around every feature word, and one from each text's middle: the different ones as kinds and
    toxic tags, and how often each occurs.

    A feature word in a toxic text is a toxic token; every other token is not.
    """
    found: Counter = Counter()
    for kind, label in zip(kinds, toxic):
        padded = np.pad(kind, REACH + 1)
        for p in [*np.flatnonzero(kind), *([len(kind) // 2] if len(kind) else [])]:
            found[padded[p:p + 2 * REACH + 3].tobytes(), bool(label)] += 1
    rows = np.frombuffer(b"".join(row for row, _ in found), np.int8).reshape(-1, 2 * REACH + 3)
    tags = ((rows[:, 1:-1] > 0) & np.array([label for _, label in found], bool)[:, None]).astype(np.int8)
    return rows, tags, np.array(list(found.values()), float)


def train_crf(kind: np.ndarray, tag: np.ndarray, times: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights of the greatest penalised likelihood, by gradient steps over all windows at once;
    times: how often each window counts."""
    emission, transition = np.zeros(3 * KINDS), np.zeros((2, 2))
    emission[0] = -1.0
    (n, width), total = tag.shape, times.sum()
    slots = np.stack([kind[:, 1:-1], KINDS + kind[:, :-2].astype(int), 2 * KINDS + kind[:, 2:].astype(int)], axis=2).astype(int)
    speed_e, speed_t = np.full_like(emission, 1e-8), np.full_like(transition, 1e-8)
    for _ in range(rounds):
        phi = np.stack([np.ones((n, width)), np.exp(np.clip(emission[slots].sum(axis=2), -30, 30))], axis=2)
        step = np.exp(transition)
        forward, back = np.empty((n, width, 2)), np.empty((n, width, 2))
        for t in range(width):
            a = phi[:, 0] if t == 0 else forward[:, t - 1] @ step * phi[:, t]
            forward[:, t] = a / a.sum(axis=1, keepdims=True)
        back[:, -1] = 1.0
        for t in range(width - 2, -1, -1):
            b = (phi[:, t + 1] * back[:, t + 1]) @ step.T
            back[:, t] = b / b.sum(axis=1, keepdims=True)
        node = forward * back
        node = (node / node.sum(axis=2, keepdims=True))[:, :, 1]
        slope_e = np.zeros_like(emission)
        np.add.at(slope_e, slots, ((tag - node) * times[:, None])[:, :, None])
        slope_t = np.zeros((2, 2))
        for t in range(width - 1):
            pair = forward[:, t, :, None] * step[None] * (phi[:, t + 1] * back[:, t + 1])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            slope_t -= (pair * times[:, None, None]).sum(axis=0)
            np.add.at(slope_t, (tag[:, t].astype(int), tag[:, t + 1].astype(int)), times)
        slope_e, slope_t = slope_e / total - decay * emission, slope_t / total - decay * transition
        speed_e, speed_t = speed_e + slope_e ** 2, speed_t + slope_t ** 2
        emission, transition = emission + rate * slope_e / np.sqrt(speed_e), transition + rate * slope_t / np.sqrt(speed_t)
    return emission, transition


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the free constant."""
    w, ridge = np.zeros(x.shape[1]), np.r_[1e-3, np.full(x.shape[1] - 1, decay)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(texts: list[bytes], toxic: list[int]) -> Model:
    """A model of labelled texts. Word features of one half are learnt on the other, so the weights see honest features."""
    y, model = np.array(toxic, int), Model()
    if not len(y) or y.min() == y.max():
        model.document[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return model
    rows, words = number_words(texts)
    half = np.arange(len(y)) % 2
    kinds: list[np.ndarray] = [None] * len(rows)
    for side in (0, 1):
        learn = np.flatnonzero(half != side)
        table = word_kinds([rows[i] for i in learn], y[learn], words)
        for i in np.flatnonzero(half == side):
            kinds[i] = table[rows[i]]
    model.emission, model.transition = train_crf(*_windows(kinds, y))
    tagger, x = Tagger(model), np.zeros((len(y), 5))
    for i, kind in enumerate(kinds):
        at, probability = tagger.marginals(kind)
        x[i] = tagger.features([words[n] for n in rows[i]] if len(at) else [], probability, at)
    model.document = logistic(x, y)
    table = word_kinds(rows, y, words)
    model.kinds = {words[n]: int(table[n]) for n in np.flatnonzero(table)}
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> Model:
    """A model from the labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    At most max_rows rows are used, those of the smallest hash of doc_id; that bounds what the driver gathers. Rows
    with a null label or doc_id, or of unknown documents, are left out; repeated labels of a doc_id: the largest holds.
    """
    known = (labels.where("toxic is not null and doc_id is not null")
             .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
             .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows))
    rows = (known.join(docs.select(F.col("doc_id").alias("label_id"), "text"), "label_id")
            .select("label_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "toxic")
            .groupBy("label_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).toPandas().sort_values("label_id"))
    return fit(rows["text"].tolist(), [int(t) for t in rows["toxic"]])


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (score >= threshold) and toxic_spans (start, end, probability; byte offsets) of each row.

    Reads nothing but the text, whole; a null or empty text has no spans and the score of a text without features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            found = [tagger.score(t.as_py()) for t in batch.column(1)]
            spans = [[{"start": a, "end": b, "probability": p} for a, b, p in s] for _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, span)],
                                             names=["doc_id", "score", "toxic_spans"])

    return (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, score double, toxic_spans array<struct<start:long,end:long,probability:double>>")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from the training; one without doc_id has no label to be kept from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 8_000) -> DataFrame:
    """docs without the rows that score at threshold or above; columns unchanged.

    The score is computed on the row itself in the same pass, so no text is shuffled and repeated or null doc_ids need
    no care.
    """
    model = train_toxicity(docs, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            keep = [tagger.score((t.as_py() or "").encode("utf-8", "surrogatepass"))[0] < threshold for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

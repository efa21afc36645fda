"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score is w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i (v_if x_i)**2), linear in the
number of active features; a logistic function makes it a probability.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed word features; structure features follow, each one-hot over its bins.
WORD_SPACE = 1 << 14
FACTORS = 6
#: Labelled rows that a fit reads at most, for each class; taken by a hash of their id.
FIT_ROWS = 4000
BINS = 12

STRUCTURE = ("length", "upper", "letters", "digits", "marks", "word_length", "distinct", "line_length", "repeated_lines", "tailed_words", "mark_runs", "symbols", "lone_words", "longest_word")
#: Marks of ordinary prose; all others are symbols.
PROSE_MARKS = ".,;:!?'\"()-\u2019\u2018\u201c\u201d\u2013\u2014\u2026\u3002\u3001"


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of each code point of the basic plane: 0 symbol, 1 letter, 2 capital, 3 digit, 4 space, 5 mark of prose."""
    of = {"L": 1, "N": 3, "Z": 4}
    table = np.array([4 if chr(c).isspace() else 2 if (k := unicodedata.category(chr(c))) == "Lu" else of.get(k[0], 0) for c in range(1 << 16)], np.uint8)
    table[[ord(c) for c in PROSE_MARKS]] = 5
    return table


def structure(text: str, words: list[str]) -> list[float]:
    """Statistics in 0..1, in the order of STRUCTURE; an empty text has zeros throughout."""
    n, k = max(1, len(text)), max(1, len(words))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[np.minimum(points, 0xFFFF)]
    symbols, letters, capitals, digits, _, marks = np.bincount(kind, minlength=6).tolist()
    letters, marks = letters + capitals, marks + symbols
    mark = (kind == 0) | (kind == 5)
    ends = np.concatenate((kind[1:] == 4, [True])) if len(text) else np.empty(0, bool)
    tailed = int((mark[1:] & mark[:-1] & ends[1:]).sum())
    runs = int((mark[1:] & (points[1:] == points[:-1])).sum())
    lines = text.split("\n")
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    return [
        min(1.0, math.log1p(len(text)) / 12),
        capitals / max(1, letters),
        letters / n,
        digits / n,
        min(1.0, 2 * marks / n),
        min(1.0, float(lens.sum()) / k / 16),
        len(set(words)) / k,
        min(1.0, math.log1p(n / len(lines)) / 8),
        1 - len(set(lines)) / len(lines),
        min(1.0, tailed / k),
        min(1.0, runs / k),
        min(1.0, 2 * symbols / k),
        float((lens == 1).sum()) / k,
        min(1.0, float(lens.max()) / 64),
    ]


class Featuriser:
    """Feature numbers and values of a text: L2-normalised hashed words, then one-hot bins.

    Values of one text: the words share a length of 1, each structure and metadata bin has 0.5.
    """

    def __init__(self, metadata: int, cache: int = 400_000) -> None:
        self.size = WORD_SPACE + (len(STRUCTURE) + metadata) * (BINS + 1)
        self.cache, self.known = cache, {}

    def __call__(self, text: str | None, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        known = self.known
        if len(known) > self.cache:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % WORD_SPACE
        at, count = np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), return_counts=True)
        weight = np.sqrt(count)
        weight /= max(1e-9, math.sqrt(float(weight @ weight)))
        stats = [int(x * (BINS - 1) + 0.999) for x in structure(text, words)] + [BINS if m is None else min(BINS - 1, int(math.log2(1 + max(0.0, m)) * 0.6)) for m in metadata]
        dense = WORD_SPACE + np.arange(len(stats)) * (BINS + 1) + np.array(stats)
        return np.concatenate((at, dense)).astype(np.int32), np.concatenate((weight, np.full(len(stats), 0.5))).astype(np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; start: where each row's features begin."""
        weighed = self.factors[at] * value[:, None]
        total = np.add.reduceat(weighed, start)
        squares = np.add.reduceat(weighed * weighed, start)
        return self.bias + np.add.reduceat(self.linear[at] * value, start) + 0.5 * (total * total - squares).sum(1)

    def score(self, at: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(at, value, start).astype(np.float64), -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, size: int, *, epochs: int = 12, rate: float = 0.05, decay: float = 2e-5, seed: int = 5) -> FactorisationMachine:
    """Weighted logistic loss, mini-batches, AdaGrad. Without rows the score is 0.5 everywhere."""
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    if not rows:
        return model
    share = float(np.clip((label * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    model.bias = math.log(share / (1 - share))
    seen_b, seen_w, seen_v = 1e-6, np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            at = np.concatenate([rows[k][0] for k in part])
            value = np.concatenate([rows[k][1] for k in part])
            lens = np.array([len(rows[k][0]) for k in part])
            start = np.concatenate(([0], np.cumsum(lens)[:-1]))
            row = np.repeat(np.arange(len(part)), lens)
            weighed = model.factors[at] * value[:, None]
            total = np.add.reduceat(weighed, start)
            error = ((model.score(at, value, start) - label[part]) * weight[part]).astype(np.float32)
            g = error[row] * value
            own, inverse = np.unique(at, return_inverse=True)
            grad_w = np.bincount(inverse, g, own.size).astype(np.float32) / len(part) + decay * model.linear[own]
            by_v = g[:, None] * (total[row] - weighed)
            grad_v = np.stack([np.bincount(inverse, by_v[:, f], own.size) for f in range(FACTORS)], 1).astype(np.float32) / len(part) + decay * model.factors[own]
            grad_b = float(error.mean())
            seen_b += grad_b**2
            seen_w[own] += grad_w**2
            seen_v[own] += grad_v**2
            model.bias -= rate * grad_b / math.sqrt(seen_b)
            model.linear[own] -= rate * grad_w / np.sqrt(seen_w[own])
            model.factors[own] -= rate * grad_v / np.sqrt(seen_v[own])
    return model


def held_out(id_col: str = "doc_id"):
    """Rows whose labels no fit may read: crc32 of the id as text leaves 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), fit_rows: int = FIT_ROWS) -> FactorisationMachine:
    """Fits on labelled rows that are not held out: of each class at most `fit_rows`, the first by
    a hash of the id, so that the same rows are taken at every run. Each class weighs as it does
    among all labelled rows. Rows with a null id or label teach nothing; a row labelled twice
    counts once, with the larger label; of documents that repeat an id the one whose text has the
    smallest hash teaches. 2 * fit_rows rows reach the driver at most."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id")).groupBy("_id").agg(F.max("_label").alias("_label"))
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    picked = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows) for k in (0, 1)]
    ids = picked[0].union(picked[1])
    # At most 2 * fit_rows ids: a proven bound, so that documents need no shuffle.
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(m).cast("double").alias(f"_m{k}") for k, m in enumerate(metadata)]).join(F.broadcast(ids), "_id")
    told = ["at", "value"]
    each = _features(found.withColumn("_order", F.coalesce(F.xxhash64("_text"), F.lit(0))), len(metadata), ["_id", "_label", "_order"])
    one = each.groupBy("_id", "_label").agg(F.min(F.struct("_order", *told)).alias("x")).select("_id", "_label", *[f"x.{c}" for c in told]).collect()
    assert len(one) <= 2 * fit_rows
    one.sort(key=lambda r: (r["_id"], r["at"], r["value"]))
    y = np.array([r["_label"] for r in one], np.float64)
    weight = np.ones(len(one))
    for k, n in sizes.items():
        mine = y == k
        if mine.any():
            weight[mine] = n / mine.sum()
    weight *= len(one) / max(1e-9, weight.sum())
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in one]
    return fit(rows, y, weight, Featuriser(len(metadata)).size)


def _features(found: DataFrame, metadata: int, keep: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featuriser(metadata)
        for part in parts:
            numbers = [part.column(f"_m{k}").to_pylist() for k in range(metadata)]
            got = [of(t.as_py(), [c[i] for c in numbers]) for i, t in enumerate(part.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], [*keep, "at", "value"])

    return found.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", at binary, value binary")


def classify(docs: DataFrame, model: FactorisationMachine, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """Scores every whole text: the input's columns, then score double and predicted int.

    Null and empty texts are scored from their (zero) statistics; null metadata has a bin of its
    own. Ids may be null or repeat. Input columns of the names score and predicted are replaced.
    The broadcast model's size is fixed by the feature space. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(metadata)
    kept = [f for f in docs.schema if f.name not in ("score", "predicted")]

    held: list[Featuriser] = []

    def scores(texts, *numbers):
        if not held:
            held.append(Featuriser(n))
        of, m = held[0], shared.value
        out = []
        listed = [c.to_pylist() for c in numbers]
        for s in range(0, len(texts), 256):
            rows = [of(t.as_py(), [None if c[s + i] is None else float(c[s + i]) for c in listed]) for i, t in enumerate(texts[s : s + 256])]
            start = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])[:-1])).astype(np.int64)
            out.append(m.score(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), start))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    scored = F.arrow_udf(scores, "double")
    columns = [F.col(f"`{f.name}`") for f in kept]
    with_score = docs.select(*columns, scored(F.col(text_col), *[F.col(m).cast("double") for m in metadata]).alias("score"))
    return with_score.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Operator 8: a quality classifier by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector over hashed text features for all grades, and ordered
thresholds. It gives an expected grade and tail probabilities P(grade >= k) to select by. One further feature says whether
a text holds any word that marks toxic documents among the well-formed ones, whatever the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import ngram_counts, unit
from .language import hash_of, sample_by_hash
from .storage import small_batches
from .tokens import give_back, slices

BITS, ORDERS = 13, (1, 2, 3)
#: Labelled rows of each grade that the model learns from, at most.
ROWS_PER_GRADE = 800
#: Rows that a product of the fit goes through at once.
ROWS_AT_ONCE = 128
#: Grades: 0 poor, 1 well-formed but toxic, 2 well-formed.
GRADES = 3
#: A document is well-formed (keep) if P(grade >= KEEP_GRADE) is KEEP_SHARE at least.
KEEP_GRADE, KEEP_SHARE = 1, 0.5
#: It is clean if P(grade >= 2) reaches a threshold, too, chosen on labelled documents that the model hasn't seen; of those of grade 2 this share stays at least.
CLEAN_KEPT = 0.97
#: Least log-likelihood ratio at which a word marks toxic documents.
MARKS = 20.0
_WORD = re.compile(r"\w+")


def _shape(text: str, data: np.ndarray) -> list[str]:
    """Words about the form of a text, hashed like its n-grams: shares of kinds of characters, word lengths, repetition; each in coarse steps."""
    n = max(len(data), 1)
    upper, lower = int(((data >= 65) & (data <= 90)).sum()), int(((data >= 97) & (data <= 122)).sum())
    digit, space = int(((data >= 48) & (data <= 57)).sum()), int((data == 32).sum() + (data == 10).sum())
    other = n - upper - lower - digit - space - int((data >= 128).sum())
    words = text.split()
    m = max(len(words), 1)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    steps = {"upper": upper / max(upper + lower, 1), "other": other / n, "digit": digit / n, "space": space / n, "same": same / m}
    out = [f"{k} {min(int(np.ceil(v * 20)), 10)}" for k, v in steps.items()]
    out += [f"distinct {int(np.ceil(10 * len(set(words)) / m))} of {min(int(np.log2(m)), 10)}", f"length {min(int(n / m), 20)}", f"lines {min(int(20 * text.count(chr(10)) / m), 10)}", f"size {min(int(np.log2(m)), 14)}"]
    return out


def features(text: str) -> np.ndarray:
    """Hashed byte n-grams, case kept, and hashed words about the form; both parts have length 1."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    x = unit(ngram_counts(data.astype(np.uint32), BITS, ORDERS))
    shape = np.zeros(len(x), np.float32)
    words = _shape(text, data)
    for word in words:
        shape[hash_of(word) & (len(x) - 1)] += 1
    return x + shape / np.float32(np.sqrt(len(words)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, marks: frozenset[str] = frozenset(), least_best: float = 0.0):
        """``marks``: words of toxic documents, if the last weight is that of their feature; ``least_best``: the threshold of P(grade >= 2)."""
        self.weights, self.thresholds, self.marks, self.least_best = weights, thresholds, marks, least_best

    def rate(self, text: str) -> np.ndarray:
        """The tails of a text."""
        x = features(text)
        if len(self.weights) > len(x):
            x = np.append(x, np.float32(not self.marks.isdisjoint(_WORD.findall(text.lower()))))
        return self.tails(x)

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: falling, since the thresholds rise."""
        return _sigmoid(x @ self.weights - self.thresholds)

    def best_of(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= 2) of each row."""
        return _sigmoid(x @ self.weights - self.thresholds[-1])


class Rows:
    """Rows of features of which most are zero (``at``: the columns of the others, ``value``, ``edges``: where each row's begin and end), and a last column, ``marked``, that is there whole.

    Both products go through ROWS_AT_ONCE rows at a time: the whole table of the learned rows would be many times as large.
    """

    __array_ufunc__ = None  # so that ``array @ rows`` is the product below

    def __init__(self, at: np.ndarray, value: np.ndarray, edges: np.ndarray, marked: np.ndarray, columns: int):
        self.at, self.value, self.edges, self.marked, self.shape = at, value, edges, marked, (len(marked), columns + 1)

    def __len__(self) -> int:
        return len(self.marked)

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.edges)[rows]
        edges = np.concatenate([[0], np.cumsum(size)])
        at, value = np.empty(edges[-1], self.at.dtype), np.empty(edges[-1], np.float32)
        for k, i in enumerate(rows.tolist()):
            at[edges[k] : edges[k + 1]], value[edges[k] : edges[k + 1]] = self.at[self.edges[i] : self.edges[i + 1]], self.value[self.edges[i] : self.edges[i + 1]]
        return Rows(at, value, edges, self.marked[rows], self.shape[1] - 1)

    def _parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First row, columns, values and inner edges of some rows."""
        for lo in range(0, len(self), ROWS_AT_ONCE):
            edges = self.edges[lo : lo + ROWS_AT_ONCE + 1]
            yield lo, self.at[edges[0] : edges[-1]], self.value[edges[0] : edges[-1]], edges - edges[0]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        out = self.marked * w[-1]
        for lo, at, value, edges in self._parts():
            some = np.flatnonzero(np.diff(edges))
            if len(some):
                out[lo + some] += np.add.reduceat(value * w[at], edges[some])
        return out

    def __rmatmul__(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for lo, at, value, edges in self._parts():
            out[:-1] += np.bincount(at, value * np.repeat(g[lo : lo + len(edges) - 1], np.diff(edges)), self.shape[1] - 1)
        out[-1] = g @ self.marked
        return out


def fit(x: np.ndarray | Rows, y: np.ndarray, grades: int = GRADES, ridge: float = 2e-4, steps: int = 300, rate: float = 0.3) -> Model:
    """Least negative log-likelihood with an L2 penalty, by Adam on all rows; each grade weighs the same. Thresholds rise by exp of free parameters."""
    count = np.bincount(y, minlength=grades)
    weight = (1 / np.maximum(count, 1))[y] / max((count > 0).sum(), 1)
    theta = np.concatenate([np.zeros(x.shape[1]), [-0.5], np.zeros(grades - 2)])
    m, v, d = np.zeros_like(theta), np.zeros_like(theta), x.shape[1]
    for t in range(1, steps + 1):
        w, cuts = theta[:d], np.cumsum(np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])]))
        score = x @ w.astype(np.float32)
        below = np.concatenate([np.zeros((len(x), 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((len(x), 1))], 1)
        p = np.maximum(below[np.arange(len(x)), y + 1] - below[np.arange(len(x)), y], 1e-9)
        slope = below * (1 - below)
        up, low = slope[np.arange(len(x)), y + 1], slope[np.arange(len(x)), y]
        g_score = weight * (up - low) / p  # of -log p
        g_cut = np.zeros(grades - 1)
        for k in range(grades - 1):
            g_cut[k] = -(weight * ((y == k) * up - (y == k + 1) * low) / p).sum()
        grad = np.concatenate([(g_score.astype(np.float32) @ x) + ridge * w, [g_cut.sum()], np.exp(theta[d + 1 :]) * np.cumsum(g_cut[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - t / (steps + 1))
    return Model(theta[:d].astype(np.float32), np.cumsum(np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])])))


def marking_words(words: list[np.ndarray], y: np.ndarray, known: int) -> np.ndarray:
    """Whether each of ``known`` words marks toxic documents: it is in more of them than of the other well-formed ones, by a log-likelihood ratio of MARKS at least. ``words``: the numbers of each document's words, ascending; documents of the same words count once."""
    toxic, clean = (list({w.tobytes(): w for w, g in zip(words, y.tolist(), strict=True) if g == k}.values()) for k in (1, 2))
    if not toxic or not clean:
        return np.zeros(known, bool)
    a, b = (np.bincount(np.concatenate(docs), minlength=known).astype(np.float64) for docs in (toxic, clean))
    m, n = len(toxic), len(toxic) + len(clean)
    cells = ((a, m, a + b), (b, n - m, a + b), (m - a, m, n - a - b), (n - m - b, n - m, n - a - b))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * sum(k * np.log(np.maximum(k, 1e-9) * n / np.maximum(row * column, 1e-9)) for k, row, column in cells)
    return (ratio >= MARKS) & (a * (n - m) > b * m) & (a > 0)


def fit_marked(x: Rows, y: np.ndarray, words: list[np.ndarray], known: int) -> tuple[Model, np.ndarray]:
    """Fit on features and, in the last column of ``x``, the feature of marking words, which is filled in here; and which words they are."""
    marks = marking_words(words, y, known)
    x.marked[:] = [marks[w].any() for w in words]
    return fit(x, y), marks


def least_best(x: Rows, y: np.ndarray, words: list[np.ndarray], known: int) -> float:
    """The P(grade >= 2) that tells toxic from other well-formed documents best, each scored by the model of the other half, of those that CLEAN_KEPT of the latter reach. 0, which rejects none, where a half has no toxic or no other well-formed documents."""
    best, part = np.zeros(len(y)), np.arange(len(y)) % 2
    for k in (0, 1):
        learn, held = np.flatnonzero(part == k), np.flatnonzero(part != k)
        if not {1, 2} <= set(y[learn].tolist()):
            return 0.0
        model, marks = fit_marked(x.take(learn), y[learn], [words[i] for i in learn], known)
        rest = x.take(held)
        rest.marked[:] = [marks[words[i]].any() for i in held]
        best[held] = model.best_of(rest)
    toxic, clean = np.sort(best[y == 1]), np.sort(best[y == 2])
    at = np.concatenate([[0.0], clean[: int((1 - CLEAN_KEPT) * len(clean)) + 1]])
    gain = np.searchsorted(toxic, at) / len(toxic) - np.searchsorted(clean, at) / len(clean)
    return float(at[gain.argmax()])


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade from quality and toxic flags. Rows without doc_id or quality are left out; a null toxic counts as 0; of several ratings of a document the lowest holds."""
    good = F.col("quality") > 0
    grade = F.when(~good, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, rated: DataFrame, most: int = ROWS_PER_GRADE) -> Model | None:
    """Fit on at most ``most`` rated documents of each grade, chosen by a hash of doc_id; of several texts of a doc_id, the one of the lowest hash. None without two grades of rated documents."""
    chosen = sample_by_hash(rated, "grade", most).collect()
    chosen = sorted(chosen, key=lambda r: (hash_of(r.doc_id), r.doc_id))
    kept, seen = [], [0] * GRADES
    for r in chosen:
        seen[r.grade] += 1
        if seen[r.grade] <= most:
            kept.append((r.doc_id, r.grade))
    if not kept:
        return None
    grades = docs.sparkSession.createDataFrame(kept, "doc_id long, grade int")  # GRADES * most rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [(np.flatnonzero(x).astype(np.int16), x[x != 0], sorted(set(_WORD.findall(text.lower())))) for text in texts for x in [features(text)]]
            kinds = {"at": pa.list_(pa.int16()), "x": pa.list_(pa.float32()), "words": pa.list_(pa.string())}
            yield pa.record_batch({"doc_id": batch.column(0), "grade": batch.column(2)} | {k: pa.array([row[i] for row in found], kind) for i, (k, kind) in enumerate(kinds.items())})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(grades), "doc_id").select("doc_id", "text", "grade")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("first", first).where("first = 1").select("doc_id", "text", "grade")
    found = rows.mapInArrow(run, "doc_id long, grade int, at array<short>, x array<float>, words array<string>").toArrow()
    keys = found["doc_id"].to_pylist()
    first = sorted(((k, i) for i, k in enumerate(keys)), key=lambda p: (hash_of(p[0]), p[0]))
    y = np.array([found["grade"][i].as_py() for _, i in first], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    spelled = found["words"].combine_chunks()
    flat = spelled.flatten().dictionary_encode()
    known, numbers, edges = flat.dictionary, np.asarray(flat.indices), np.asarray(spelled.offsets)
    words = [np.sort(numbers[edges[i] - edges[0] : edges[i + 1] - edges[0]]) for _, i in first]
    at, value = (found[c].combine_chunks() for c in ("at", "x"))
    edges = np.asarray(at.offsets).astype(np.int64)
    x = Rows(at.flatten().to_numpy(), value.flatten().to_numpy(), edges - edges[0], np.zeros(len(at), np.float32), 1 << BITS).take(np.array([i for _, i in first]))
    del found, spelled, flat, numbers, at, value  # the fit takes far longer than all of this
    give_back()
    threshold = least_best(x, y, words, len(known))
    model, marks = fit_marked(x, y, words, len(known))
    model.marks, model.least_best = frozenset(known.filter(pa.array(marks)).to_pylist()), threshold
    del x, words
    give_back()
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, expected_grade, p_good and p_best (tail probabilities of grades 1 and 2), keep (well-formed) and clean (well-formed and not toxic) for every row of ``docs`` (doc_id, text).

    Null counts as the empty text. Without a model all is kept, with null scores. Repeated rows are answered as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.record_batch({"doc_id": batch.column(0), **grade_columns(texts, model)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_good double, p_best double, keep boolean, clean boolean")


def grade_columns(texts: list[str], model: Model | None) -> dict[str, pa.Array]:
    if model is None:
        none = pa.nulls(len(texts), pa.float64())
        return {"expected_grade": none, "p_good": none, "p_best": none, "keep": pa.array([True] * len(texts)), "clean": pa.array([True] * len(texts))}
    tails = np.array([model.rate(t) for t in texts]).reshape(len(texts), GRADES - 1)
    keep = tails[:, KEEP_GRADE - 1] >= KEEP_SHARE
    return {"expected_grade": pa.array(tails.sum(1)), "p_good": pa.array(tails[:, 0]), "p_best": pa.array(tails[:, 1]), "keep": pa.array(keep), "clean": pa.array(keep & (tails[:, 1] >= model.least_best))}


def select(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are clean, with all their columns (whatever their names) and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield batch.filter(grade_columns(texts, model)["clean"])

    return docs.mapInArrow(run, docs.schema) if model is not None else docs


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of every document, learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, ratings(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}

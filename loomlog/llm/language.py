"""Operator 2: language identification in two steps.

A linear support vector machine per family (one against the rest) finds the language family; within it, one machine
for each pair of languages votes. Features are hashed counts of one to three letters over the whole text. Everything is
learned here, from a bounded sample of labelled rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import letter_codes, ngram_counts, unit
from .storage import materialize, small_batches
from .tokens import slices

BITS, ORDERS = 13, (1, 2, 3)
#: Labelled rows per language that the model learns from, at most; they are chosen by a hash of doc_id.
ROWS_PER_LANGUAGE = 300
#: Labels up to which their counts are sent to all executors, so that no text is shuffled; more are joined.
MOST_LABELS = 100_000
#: Families of common languages. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa sa ur",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tr tt ug uz",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "iranian": "fa ku ps tg",
    "austronesian": "id jv mg ms su tl",
    "dravidian": "kn ml ta te",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def features(text: str) -> np.ndarray | None:
    codes = letter_codes(text)
    return None if codes is None else unit(ngram_counts(codes, BITS, ORDERS))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by dual coordinate descent. y: 1 or -1. Rows count so that both sides weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, rng = np.zeros(x.shape[1], np.float64), np.zeros(len(x)), np.random.default_rng(seed)
    cost = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * c
    diag = 1 / (2 * cost)
    norm = (x.astype(np.float64) ** 2).sum(1) + diag
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = max(0.0, alpha[i] - (y[i] * float(x[i] @ w) - 1 + diag[i] * alpha[i]) / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """families: the weights of each family against the rest; pairs: those of each pair of languages in a family, positive for the first."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = sorted(langs)
        groups: dict[str, list[str]] = {}
        for lang in self.langs:
            groups.setdefault(family(lang), []).append(lang)
        self.groups = [groups[k] for k in sorted(groups)]
        of = {lang: k for k, group in enumerate(self.groups) for lang in group}
        which = np.array([of[lang] for lang in y], dtype=np.int64)
        empty = np.zeros((x.shape[1] + 1 if len(x) else (1 << BITS) + 1, 0), np.float32)
        many = len(self.groups) > 1
        self.first = np.stack([fit_svm(x, np.where(which == k, 1, -1)) for k in range(len(self.groups))], 1) if many else empty
        self.pairs, weights = [], []
        for k, group in enumerate(self.groups):
            for a, b in itertools.combinations(group, 2):
                rows = np.isin(y, [a, b])
                self.pairs.append((k, a, b))
                weights.append(fit_svm(x[rows], np.where(y[rows] == a, 1, -1)))
        self.second = np.stack(weights, 1) if weights else empty

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language and a score from 0 to 1: the squashed least margin of the decisions that led there."""
        margins, k = [], 0
        if self.first.shape[1]:
            s = x @ self.first[:-1] + self.first[-1]
            k = int(np.argmax(s))
            margins.append(float(s[k]))
        votes = dict.fromkeys(self.groups[k], (0, 0.0))
        own = [(i, a, b) for i, (g, a, b) in enumerate(self.pairs) if g == k]
        if own:
            s = x @ self.second[:-1][:, [i for i, _, _ in own]] + self.second[-1][[i for i, _, _ in own]]
            least: dict[str, float] = {}
            for (_, a, b), m in zip(own, s.tolist(), strict=True):
                won, lost = (a, b) if m >= 0 else (b, a)
                votes[won] = (votes[won][0] + 1, votes[won][1] + abs(m))
                votes[lost] = (votes[lost][0], votes[lost][1] - abs(m))
                least[a], least[b] = min(least.get(a, m), m), min(least.get(b, -m), -m)
            lang = min(votes, key=lambda v: (-votes[v][0], -votes[v][1], v))
            margins.append(least[lang])
        else:
            lang = self.groups[k][0]
        return lang, float(1 / (1 + np.exp(-3 * min(margins)))) if margins else 1.0


def held_out() -> Column:
    """Whether a row's label must not be learned from: crc32 of doc_id as text, modulo 4, is 2. Null doc_id: crc32 of the empty text, so no."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4) == 2


def sample_by_hash(rows: DataFrame, label: str, most: int) -> DataFrame:
    """About ``most`` rows (doc_id, ``label`` and others) of each label (a few more; all, if there are fewer), those whose hash of doc_id is low; of rows that share doc_id and label one. Counts come first, so nothing is shuffled but them and what is chosen."""
    counts = materialize(rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n")), "labels")
    counts = F.broadcast(counts) if counts.count() <= MOST_LABELS else counts
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    low = rows.join(counts, F.col(label) == F.col("__label")).where(share <= F.least(F.lit(1.0), F.lit(1.1 * most + 20) / F.col("__n")) * float(1 << 40)).drop("__label", "__n")
    rank = F.row_number().over(Window.partitionBy(label, "doc_id").orderBy(F.xxhash64(*(F.col(c) for c in rows.columns))))
    return low.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def train(docs: DataFrame, most: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from text and lang of the rows that aren't held out and have both; at most ``most`` rows a language reach the driver's fit."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [(key, lang, np.flatnonzero(x).astype(np.int16), x[x != 0]) for key, text, lang in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True) if (x := features(text)) is not None]
            kinds = {"doc_id": pa.int64(), "lang": pa.string(), "at": pa.list_(pa.int16()), "x": pa.list_(pa.float32())}
            yield pa.record_batch({k: pa.array([row[i] for row in found], kind) for i, (k, kind) in enumerate(kinds.items())})

    found = sample_by_hash(known, "lang", most).mapInArrow(run, "doc_id long, lang string, at array<short>, x array<float>").toArrow()
    order = sorted(range(found.num_rows), key=lambda i: (hash_of(found["doc_id"][i].as_py()), found["lang"][i].as_py()))
    seen: dict[str, int] = {}
    rows = []
    for i in order:
        lang = found["lang"][i].as_py()
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= most:
            rows.append(i)
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, i in enumerate(rows):
        x[k, found["at"][i].values.to_numpy()] = found["x"][i].values.to_numpy()
    return Model(list(seen), x, np.array([found["lang"][i].as_py() for i in rows], dtype=object))


def hash_of(key: int | None) -> int:
    """An order of rows that has nothing to do with where they stand."""
    import zlib

    return zlib.crc32(str(key).encode())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text; no other column is looked at).

    ``und`` with score 0 for null, empty and letterless texts, and for all if there was nothing to learn from.
    Repeated rows are answered as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out = [("und", 0.0) if not model.langs or (x := features(t)) is None else model.predict(x) for t in texts]
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array([a for a, _ in out], pa.string()), "score": pa.array([b for _, b in out], pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))


QUERIES = {"op2_language": op2_language}
ORACLE_SQL: dict[str, str] = {}

"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good (from the labels' ``toxic`` and ``quality``). One
weight vector over hashed words (presence, not counts) and a few shape measures
gives a score s; ordered thresholds t1 < t2 give P(grade >= j) = 1/(1+exp(t_j-s)).
A document is kept if its upper tail P(grade >= 2) reaches ``min_tail``.

Every word of the sample has a weight. A word's column is scaled by its evidence, the
log ratio of its smoothed odds of a lower grade to the sample's odds: a word seen once
or twice gets a small column, and the penalty on the weights then holds it down.

Fitting uses a bounded, seeded sample of labelled documents (``max_fit_rows``, a
parameter of :func:`fit`); scoring covers every whole text.

Defined results: a NULL or empty text has no features and is scored by the
intercept; repeated rows get equal scores; without any usable label the model
keeps everything (tail 1); an empty table gives an empty result; columns other
than id and text are not read; a score column whose name the documents have already
gets leading underscores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from riskloom.llm import textnum as T
from riskloom.llm.common import fresh, load, small_batches, text_or_empty

N_HASH = 1 << 18
N_SHAPE = 8
MAX_FIT_ROWS = 12_000
MIN_TAIL = 0.5

# words of the hashed vocabulary: ASCII letters (case folded) and all bytes from 0x80 up
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[128:] = True
_NOT_LETTER = ~_LETTER
_UPPER = T.byte_class(bytes(range(ord("A"), ord("Z") + 1)))
_MARK = T.byte_class(b"!\"#$%&'*+/<=>?@[\\]^_`{|}~")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def features(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct word buckets, shape measures) of a text."""
    starts, ends = T.word_bounds(text, _NOT_LETTER)
    n = len(starts)
    if not n:
        return np.empty(0, np.int32), np.zeros(N_SHAPE, np.float32)
    hashes = T.word_hashes(_LOWER[text], starts, ends, salt=8)
    distinct = np.unique((hashes >> T.U64(64 - 18)).astype(np.int32))
    marks, upper, letters = int(_MARK[text].sum()), int(_UPPER[text].sum()), int((ends - starts).sum())
    shape = np.array(
        [
            min(1.0, marks / n),
            float(marks > 0.05 * n),
            float(marks > 0.3 * n),
            upper / letters,
            float(upper > 0.3 * letters),
            len(distinct) / n,
            float(len(distinct) < 0.3 * n),
            float(n < 10),
        ],
        np.float32,
    )
    return distinct, shape


@dataclass
class Model:
    """Weights of the word buckets (zero for buckets not in the sample), shape weights, thresholds."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_HASH, np.float32))
    shape: np.ndarray = field(default_factory=lambda: np.zeros(N_SHAPE))
    cuts: np.ndarray = field(default_factory=lambda: np.array([-40.0, -39.0]))

    def score(self, buckets: np.ndarray, shape: np.ndarray) -> float:
        return float(shape @ self.shape) + float(self.weights[buckets].sum(dtype=np.float64))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, one column each."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - np.asarray(score)[:, None], -50, 50)))


def evidence(grades: np.ndarray, row: np.ndarray, column: np.ndarray, d: int, smooth: float) -> np.ndarray:
    """Per word the largest absolute log ratio of its odds of a grade up to j to the sample's odds, with ``smooth`` documents of prior."""
    scale, df, n = np.zeros(d), np.bincount(column, minlength=d), len(grades)
    for j in (0, 1):
        low = grades <= j
        share = low.mean()
        if 0 < share < 1:
            inside = np.bincount(column, low[row], d)
            odds = (inside + smooth * share) / (df - inside + smooth * (1 - share))
            scale = np.maximum(scale, np.abs(np.log(odds / (share / (1 - share)))))
    return scale


def fit_arrays(
    grades: np.ndarray, buckets: list[np.ndarray], shapes: np.ndarray, smooth: float = 4.0, l2: float = 1e-2, steps: int = 150, rate: float = 0.1
) -> Model:
    """Maximum likelihood with an L2 penalty on the words, by Adam on the whole sample (deterministic)."""
    if not len(grades) or len(np.unique(grades)) < 2:
        return Model()
    n = len(grades)
    flat = np.concatenate(buckets)
    row = np.repeat(np.arange(n), [len(b) for b in buckets])
    seen = np.bincount(flat, minlength=N_HASH) > 0
    names, column = np.flatnonzero(seen), (np.cumsum(seen) - 1)[flat]  # as np.unique, without a sort's copies
    d = len(names)
    del flat, buckets
    scale = evidence(grades, row, column, d, smooth)
    # parameters: bucket weights, shape weights, first cut, log gap to the second
    theta = np.zeros(d + N_SHAPE + 2)
    theta[-2] = -2.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    share = np.bincount(grades, minlength=3) / n
    weight = np.where(share > 0, 1 / np.sqrt(np.maximum(share, 1e-9)), 0)[grades]
    weight /= weight.mean()
    for step in range(1, steps + 1):
        w, v, cut, gap = theta[:d], theta[d:-2], theta[-2], np.exp(theta[-1])
        s = np.bincount(row, (w * scale)[column], n) + shapes @ v
        p1, p2 = (1 / (1 + np.exp(np.clip(c - s, -50, 50))) for c in (cut, cut + gap))
        d1, d2 = p1 * (1 - p1), p2 * (1 - p2)
        # likelihood of the grade, its derivatives in s, cut and the second cut
        like = np.maximum(np.select([grades == 0, grades == 1], [1 - p1, p1 - p2], p2), 1e-9)
        by_s = np.select([grades == 0, grades == 1], [-d1, d1 - d2], d2) / like * weight
        by_1 = np.select([grades == 0, grades == 1], [d1, -d1], 0) / like * weight
        by_2 = np.select([grades == 0, grades == 1], [0, d2], -d2) / like * weight
        grad = np.concatenate(
            [np.bincount(column, by_s[row], d) * scale / n - l2 * w, by_s @ shapes / n - l2 / 100 * v, [(by_1 + by_2).mean(), by_2.mean() * gap]]
        )
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(N_HASH, np.float32)
    weights[names] = theta[:d] * scale
    return Model(weights, theta[d:-2], np.array([theta[-2], theta[-2] + np.exp(theta[-1])]))


def _feature_rows(rows: DataFrame) -> DataFrame:
    """place, tie, grade and the features of column ``text``."""

    def run(batches):
        for batch in batches:
            found = [features(t) for t in T.byte_rows(batch.column(3))]
            parts = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *parts], ["place", "tie", "grade", "buckets", "shape"])

    small_batches(rows.sparkSession)
    return rows.select("place", "tie", "grade", "text").mapInArrow(run, "place long, tie long, grade int, buckets array<int>, shape array<float>")


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade; labels without a grade (both NULL) or id go, the lowest grade of an id counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _rows_of(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as views of its values: no Python number is made of any."""
    whole = lists.combine_chunks()
    offsets = whole.offsets.to_numpy()
    return np.split(whole.values.to_numpy(), offsets)[1:-1]


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, seed: int = 8) -> Model:
    """Fit on at most ``max_fit_rows`` labelled documents, drawn by a keyed hash of the id."""
    place = F.xxhash64(F.lit(seed), "doc_id")
    known = docs.select("doc_id").dropna().distinct()  # labels of absent documents take no place in the sample
    sample = graded(labels).join(known, "doc_id", "left_semi").orderBy(place, "doc_id").limit(max_fit_rows)
    ids = F.broadcast(sample.withColumnRenamed("doc_id", "_fit_id"))  # at most max_fit_rows rows of 12 bytes
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(ids, F.col("doc_id") == F.col("_fit_id"))
    rows = _feature_rows(texts.select(place.alias("place"), F.xxhash64("text").alias("tie"), "grade", "text"))
    # an id may occur several times among the documents: the bound holds for the rows too
    table = rows.orderBy("place", "tie").limit(max_fit_rows).select("grade", "buckets", "shape").toArrow()
    grades = table.column("grade").to_numpy().astype(int)
    buckets, shapes = _rows_of(table.column("buckets")), table.column("shape").combine_chunks().flatten().to_numpy().astype(float)
    del table
    model = fit_arrays(grades, buckets, shapes.reshape(len(grades), N_SHAPE))
    del buckets, shapes
    pa.default_memory_pool().release_unused()  # the driver goes on to other stages
    return model


def score(docs: DataFrame, model: Model, min_tail: float = MIN_TAIL, text_column: str = "text") -> DataFrame:
    """Every column of ``docs`` as it is, then score, expected_grade, tail probabilities and keep."""
    names = fresh(docs, "score", "expected_grade", "p_not_toxic", "p_good", "keep")
    at = docs.columns.index(text_column)
    schema = docs.schema
    own = [StructField(name, BooleanType() if i == 4 else DoubleType()) for i, name in enumerate(names)]

    def run(batches):
        for batch in batches:
            text = batch.column(at).fill_null("")
            s = np.array([model.score(*features(t)) for t in T.byte_rows(text)])
            tails = model.tails(s) if len(s) else np.empty((0, 2))
            values = [s, tails.sum(1), tails[:, 0], tails[:, 1], tails[:, 1] >= min_tail]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, values)], [*schema.names, *names])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*schema.fields, *own]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose upper tail is too small go."""
    model = fit(docs, load(spark, sf_dir, "labels"))
    plain = [f"c{i}" for i in range(len(docs.columns))]  # no column of the documents can clash with the scores
    rows = score(docs.toDF(*plain), model, text_column=plain[docs.columns.index("text")])
    return rows.filter("keep").select(*plain).toDF(*docs.columns)

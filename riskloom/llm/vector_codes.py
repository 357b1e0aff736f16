"""Vector code compression: product codes by integer k-means with Drake-Hamerly adaptive bounds.

A vector of integers is cut into PARTS equal parts; each part position has a codebook
of ENTRIES entries, fitted by ROUNDS of exact integer k-means. Between rounds a table
keeps for every part its entry, an upper bound of the distance to it, its b closest
other entries in order with lower bounds (the bound at place i holds for every entry
from place i on), and one outer bound for all further entries. After the entries have
moved, the upper bound grows by the own entry's way and the lower bounds shrink by the
ways of theirs, the outer one by the longest. Where the upper bound is strictly below
the first lower bound the entry stays. Otherwise the own distance is computed, then
only the places whose bound it still reaches are compared, in integers, ties to the
lower index; if it reaches the outer bound, all entries are. Bounds are whole numbers,
upper ones rounded up and lower ones down, so that a bound never decides wrongly.

b adapts for each part position: after a round it becomes the least number of places
that settles all but one in SPARE of the parts, as the counts of places needed show.

A round reads the table once, in Arrow batches of bounded memory, and writes the next
one; tables whose successor is written are deleted. Sums by part, entry and component,
as many numbers as the codebooks have, are all that reaches the driver.

Defined results: rows whose vector is null or has null or non-finite components are
dropped, and so are those whose length is not the most common one (ties: the shorter)
among the lengths that PARTS divides; integers are held within 2**27, beyond any
embedding; first entries come from the least ids (NULL last, ties by components, rows
counted one by one), fewer than ENTRIES if there are fewer rows; repeated rows get
equal results; an empty table gives an empty result; columns other than id, vector and
label are not read. Sums too large for a long are NULL.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import attach, discard, load, saved
from riskloom.llm.vectors import LIMIT, SLOTS, finite, lists, matrix, slots, summed, whole

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
SPARE = 64  # of so many parts one may need more than the places kept
LEAST_KEPT = 2
FAR = np.int64(1) << 40  # a bound above every distance
STATE = "codes array<short>, upper array<long>, near array<short>, lower array<long>, need array<short>"


def _root_up(squares: np.ndarray) -> np.ndarray:
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return root + (root * root < squares)


def _root_down(squares: np.ndarray) -> np.ndarray:
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return root - (root * root > squares)


def _squares(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances; the arrays broadcast but for the last axis."""
    gap = vectors - entries
    return np.einsum("...i,...i->...", gap, gap)


class Part:
    """Bounds of the parts at one position, for a batch of rows."""

    def __init__(self, vectors: np.ndarray, book: np.ndarray):
        self.vectors, self.book = vectors, book

    def start(self, kept: int) -> Part:
        """All distances; the closest entry and the ``kept`` next ones with their bounds."""
        self.code = np.zeros(len(self.vectors), np.int64)
        self.upper = np.zeros(len(self.vectors), np.int64)
        self.near = np.zeros((len(self.vectors), kept), np.int64)
        self.lower = np.full((len(self.vectors), kept + 1), FAR)
        self.need = np.full(len(self.vectors), kept + 1)
        self._in_full(np.arange(len(self.vectors)))
        return self

    def resume(self, code, upper, near, lower, way: np.ndarray) -> Part:
        """Last round's bounds after each entry has gone its ``way`` (rounded up)."""
        self.code, self.near = code, near
        self.upper = upper + way[code]
        self.lower = lower - np.concatenate([way[near], np.full((len(code), 1), way.max())], axis=1)
        self._order()
        self.need = np.zeros(len(code), np.int64)
        open_ = np.flatnonzero(self._reached())
        self.upper[open_] = _root_up(_squares(self.vectors[open_], self.book[code[open_]]))
        reached = self._reached()
        self.need = reached
        for places in range(1, near.shape[1] + 1):
            self._among(np.flatnonzero(reached == places), places)
        self._in_full(np.flatnonzero(reached > near.shape[1]))
        return self

    def _order(self) -> None:
        """A bound holds for all later places, too."""
        self.lower = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1]

    def _reached(self) -> np.ndarray:
        """Places whose bound the upper bound reaches (ties count: the lower index must win)."""
        return (self.lower <= self.upper[:, None]).sum(axis=1)

    def _among(self, rows: np.ndarray, places: int) -> None:
        """The own entry against the entries at the first ``places``."""
        if not len(rows):
            return
        tried = np.concatenate([self.code[rows, None], self.near[rows, :places]], axis=1)
        self._settle(rows, tried, _squares(self.vectors[rows, None, :], self.book[tried]), places)

    def _in_full(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        tried = np.broadcast_to(np.arange(len(self.book)), (len(rows), len(self.book)))
        found = np.stack([_squares(self.vectors[rows], entry) for entry in self.book], axis=1)
        kept = min(self.near.shape[1], len(self.book) - 1)
        tried, found = self._settle(rows, tried, found, kept)
        beyond = found[:, kept + 1] if kept + 1 < len(self.book) else None
        self.lower[rows, -1] = FAR if beyond is None else _root_down(beyond)

    def _settle(self, rows, tried, found, places):
        order = np.lexsort((tried, found))
        tried, found = np.take_along_axis(tried, order, 1), np.take_along_axis(found, order, 1)
        self.code[rows] = tried[:, 0]
        self.upper[rows] = _root_up(found[:, 0])
        self.near[rows, :places] = tried[:, 1 : places + 1]
        self.lower[rows, :places] = _root_down(found[:, 1 : places + 1])
        return tried, found

    def trim(self, kept: int) -> None:
        """Keep ``kept`` places; the bound of the first one that goes becomes the outer one."""
        self._order()
        self.near, self.lower = self.near[:, :kept], self.lower[:, : kept + 1]


def _cuts(sizes: list[int]) -> list[slice]:
    ends = np.cumsum([0, *sizes])
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _assigned(rows: DataFrame, books: np.ndarray, ways=None, had=None, kept=None) -> DataFrame:
    """``rows`` (id, label, ints and, after the first round, the state) with their new state.

    ``had``: places kept so far by part position; ``kept``: from now on.
    """
    width = books.shape[0] * books.shape[2]
    parts = _cuts([books.shape[2]] * len(books))

    def run(batches):
        for batch in batches:
            vectors, done = matrix(batch.column(2), width, np.int64), []
            if had is not None:
                codes, upper = (matrix(batch.column(c), len(books), np.int64) for c in ("codes", "upper"))
                near, lower = matrix(batch.column("near"), sum(had), np.int64), matrix(batch.column("lower"), sum(had) + len(had), np.int64)
                near_at, lower_at = _cuts(had), _cuts([b + 1 for b in had])
            for p, book in enumerate(books):
                part = Part(vectors[:, parts[p]], book)
                if had is None:
                    part.start(kept[p])
                else:
                    part.resume(codes[:, p], upper[:, p], near[:, near_at[p]], lower[:, lower_at[p]], ways[p])
                part.trim(kept[p])
                done.append(part)
            short, long = pa.int16(), pa.int64()
            state = [
                lists(np.stack([d.code for d in done], 1), short), lists(np.stack([d.upper for d in done], 1), long),
                lists(np.concatenate([d.near for d in done], 1), short), lists(np.concatenate([d.lower for d in done], 1), long),
                lists(np.stack([d.need for d in done], 1), short),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *state], names)

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3]]
    names = [*rows.columns[:3], *(c.split()[0] for c in STATE.split(", "))]
    return rows.mapInArrow(run, ", ".join([*kinds, STATE]))


def _totals(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of components and, last, counts by part and entry; parts that needed 0, 1, ... places."""
    n, k, w = books.shape
    size = n * k * (w + 1)

    def run(batches):
        sums, needs = np.zeros((n, k, w + 1), np.int64), np.zeros((n, k + 1), np.int64)
        for batch in batches:
            vectors, codes, need = matrix(batch.column(0), n * w, np.int64), matrix(batch.column(1), n, np.int64), matrix(batch.column(2), n, np.int64)
            for p in range(n):
                np.add.at(sums[p, :, :w], codes[:, p], vectors[:, p * w : (p + 1) * w])
                sums[p, :, w] += np.bincount(codes[:, p], minlength=k)
                needs[p] += np.bincount(need[:, p], minlength=k + 1)
        yield slots(np.concatenate([sums.ravel(), needs.ravel()]))

    found = summed(state.select("ints", "codes", "need").mapInArrow(run, SLOTS))
    flat = np.array([found.get(i, 0) for i in range(size + n * (k + 1))], object)
    return flat[:size].reshape(n, k, w + 1), flat[size:].reshape(n, k + 1)


def moved(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The entries as floored means of their parts; unused ones stay."""
    out = books.copy()
    for p, e in np.ndindex(books.shape[:2]):
        if count := sums[p, e, -1]:
            out[p, e] = [total // count for total in sums[p, e, :-1]]
    return out


def fewest(needs: np.ndarray, kept: int) -> int:
    """Places that settle all but one in SPARE of the parts; never more than were kept."""
    beyond, total, b = needs.sum(), needs.sum(), 0
    while b < kept:
        beyond -= needs[b]
        if beyond * SPARE <= total:
            break
        b += 1
    return min(kept, max(LEAST_KEPT, b))


def compress(
    table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept vector: vec_id, label, codes, error; the final codebooks)."""
    spark = table.sparkSession
    rows = table.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v")).filter(finite("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().filter(f"d > 0 and d % {parts} = 0")
    common = lengths.orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], table.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label")).schema).select(
            "*", F.array().cast("array<short>").alias("codes"), F.lit(0).cast("long").alias("error")
        ), np.zeros((parts, 0, 0), np.int64)
    width = common["d"]

    def integers(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(whole(matrix(batch.column(2), width), scale), pa.int32())], ["vec_id", "label", "ints"])

    rows = rows.filter(F.size("v") == width)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    state = saved(rows.mapInArrow(integers, f"{kinds}, ints array<int>"), "vectors")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    books = np.array([r["ints"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    start = max(1, min(max(LEAST_KEPT, entries // 4), len(first) - 1)) if len(first) > 1 else 0
    had, kept, ways = None, [start] * parts, None
    for _ in range(rounds):
        step = saved(_assigned(state, books, ways, had, kept), "vector-bounds")
        discard(state)
        sums, needs = _totals(step, books)
        new = moved(books, sums)
        gap = (new - books).astype(object)
        ways = _root_up((gap * gap).sum(axis=2).astype(np.int64))
        adapted = kept if had is None else [fewest(needs[p], kept[p]) for p in range(parts)]
        state, books, had, kept = step, new, kept, adapted
    last = _assigned(state, books, ways, had, kept).select("vec_id", "label", "ints", "codes")

    def measured(batches):
        at = np.arange(parts)
        for batch in batches:
            codes = matrix(batch.column(3), parts, np.int64)
            cut = matrix(batch.column(2), width, np.int64).reshape(len(codes), parts, -1)
            error = _squares(cut, books[at, codes]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(error)], ["vec_id", "label", "codes", "error"])

    out = saved(last.mapInArrow(measured, f"{kinds}, codes array<short>, error long"), "vector-codes")
    discard(state)
    return out, books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(load(spark, sf_dir, "embeddings"))
    labels = saved(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    rows = attach(coded.select("vec_id", "label", code.alias("code"), "error"), labels, "label", "n")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    w = "(SELECT d // 8 FROM dim)"
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
    list_transform(embedding, lambda x: greatest(least(floor({SCALE} * x::DOUBLE), {LIMIT}), -{LIMIT})::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dim AS MATERIALIZED (SELECT len(q) AS d FROM v WHERE len(q) > 0 AND len(q) % {PARTS} = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
kept AS MATERIALIZED (SELECT * FROM v WHERE len(q) = (SELECT d FROM dim)),
parts AS MATERIALIZED (SELECT rid, p, q[p * {w} + 1 : (p + 1) * {w}] AS x FROM kept, range({PARTS}) AS t(p)),
c0 AS MATERIALIZED (
  SELECT p, e, q[p * {w} + 1 : (p + 1) * {w}] AS c
  FROM (SELECT q, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM kept), range({PARTS}) AS t(p) WHERE e < {ENTRIES})"""]  # fmt: skip
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT rid, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN c{r} USING (p))
  GROUP BY rid, p)""")  # fmt: skip
        if r < ROUNDS:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM (
    SELECT p, best.e AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{r} JOIN parts USING (rid, p), range(1, {w} + 1) AS t(j) GROUP BY ALL)
  GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, c.c) AS c FROM c{r} AS c LEFT JOIN m{r} AS m USING (p, e))""")  # fmt: skip
    return "WITH " + ",".join(steps) + f""",
r AS (
  SELECT rid, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN r USING (rid)
"""


ORACLE = _oracle()

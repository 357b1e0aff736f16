"""Embedding near-duplicates by randomised-rotation binary codes with correction factors.

Vectors are turned by pseudo-random rotations (three rounds of random signs and a
Hadamard transform). One rotation gives the code: a sign bit per coordinate, the
correction factor f (inner product of the turned vector and its code), and the turned
vector in steps of 4 bits. The inner product of a's code with b's turned vector,
divided by f, estimates the cosine of a and b without bias; its error has the standard
deviation sqrt((1 - f**2) / f**2 / (d - 1)), to which the 4-bit steps add theirs. A
pair is recomputed exactly, in double precision, unless its estimate stays below the
threshold by more than SURE standard deviations. What the recomputation confirms is a
link, nothing else.

Candidates. Further rotations give cells: the number and sign of the largest coordinate
(a cross-polytope), of as many rotations as make about CELL_ROWS vectors a cell. There
are as many tables of cells as a pair at the threshold needs to share a cell of one
with probability RECALL; the code that computes the number measures the probability
per rotation on drawn pairs. Closer pairs meet more surely.

Crowds. Where more than CROWD vectors share a cell, those within half of the
threshold's angle from a centre drawn from the cell form a ball: any two of them are
linked, so that they are counted, not compared. From here on balls and single vectors
are the units; a cell holds a ball once, however many members it has there. A vector x
and a ball of radius r around c: x is linked with all members if its angle to c plus r
is within the threshold's angle, with none if the angle less r is beyond it; otherwise
the members are compared with x exactly, in blocks. Cells of many units are cut into
blocks of BLOCK, too. No list of all pairs of a group is made.

Defined results: a vector that is null, empty, zero, or has null or non-finite
components has no links and is its own component; vectors of different lengths have
none with each other; repeated rows are linked with each other; a component without
any id has a NULL id, and a row without id is kept if its component has none; an empty
table gives an empty result; columns other than id and vector are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import attach, load, saved, spread_join
from riskloom.llm.minhash import components
from riskloom.llm.vectors import finite

THRESHOLD = 0.9
RECALL = 0.97  # least probability that a pair exactly at the threshold shares a cell
CELL_ROWS = 8
CROWD = 64
CROWD_ROUNDS = 3  # what crowds are left after them is compared in blocks
SURE = 4.0
BLOCK = 1024
PAIRS = 1 << 16  # pairs estimated at a time
SLACK = 1e-9  # of angles: beyond the error of an arc cosine away from 1, and of its sums
SEED = 13


def rotate(vectors: np.ndarray, number: int) -> np.ndarray:
    """Rotation ``number`` of the rows, padded to a power of two."""
    n, d = vectors.shape
    width = max(2, 1 << (d - 1).bit_length())
    out = np.zeros((n, width))
    out[:, :d] = vectors
    signs = np.random.default_rng([SEED, number, width]).integers(0, 2, (3, width)) * 2.0 - 1
    for turn in signs:
        out *= turn
        step = 1
        while step < width:  # Hadamard transform
            halves = out.reshape(n, -1, 2, step)
            out = np.concatenate([halves[:, :, :1] + halves[:, :, 1:], halves[:, :, :1] - halves[:, :, 1:]], axis=2).reshape(n, width)
            step *= 2
        out /= math.sqrt(width)
    return out


def corner(turned: np.ndarray) -> np.ndarray:
    """Number and sign of the largest coordinate of each row."""
    at = np.abs(turned).argmax(axis=1)
    return 2 * at + (turned[np.arange(len(turned)), at] > 0)


@functools.cache
def meeting(width: int, threshold: float, drawn: int = 20_000) -> float:
    """Probability that two vectors at the threshold have the same corner, measured on drawn pairs."""
    rng = np.random.default_rng([SEED, width])
    x, y = rng.normal(size=(2, drawn, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    return float((corner(x) == corner(threshold * x + math.sqrt(1 - threshold**2) * y)).mean())


def tables(width: int, rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(rotations that make a cell, tables of cells) for so many vectors."""
    turns = max(1, math.ceil(math.log(max(2, rows / CELL_ROWS)) / math.log(2 * width)))
    return turns, math.ceil(math.log(1 - recall) / math.log(1 - min(0.999, meeting(width, threshold) ** turns)))


def codes(units: np.ndarray) -> list[bytes]:
    """Per unit vector: factor, lowest value and step (float32), the 4-bit steps, the sign bits."""
    turned = rotate(units, 0)
    width = turned.shape[1]
    factor = np.abs(turned).sum(axis=1) / math.sqrt(width)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-30)
    steps = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 15).astype(np.uint8)
    nibbles = steps[:, ::2] << 4 | steps[:, 1::2]
    head = np.stack([factor, low, step], axis=1).astype("<f4").view(np.uint8).reshape(len(units), 12)
    return [row.tobytes() for row in np.concatenate([head, nibbles, np.packbits(turned > 0, axis=1)], axis=1)]


class Codes:
    """Opened codes of one width."""

    def __init__(self, packs: list[bytes]):
        raw = np.frombuffer(b"".join(packs), np.uint8).reshape(len(packs), -1)
        bits = raw.shape[1] - 12  # width / 2 bytes of steps and width / 8 bytes of signs, at least one
        self.width = next(w for w in (1 << k for k in range(1, 40)) if w // 2 + max(1, w // 8) == bits)
        self.factor, self.low, self.step = raw[:, :12].copy().view("<f4").astype(np.float64).T
        nibbles = raw[:, 12 : 12 + self.width // 2]
        self.steps = np.stack([nibbles >> 4, nibbles & 15], axis=2).reshape(len(raw), -1).astype(np.float32)
        self.signs = np.unpackbits(raw[:, 12 + self.width // 2 :], axis=1)[:, : self.width].astype(np.float32) * 2 - 1

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper confidence bounds of the cosines of the pairs (a[i], b[i])."""
        root, f = math.sqrt(self.width), self.factor[a]
        product = self.step[b] * np.einsum("ij,ij->i", self.signs[a], self.steps[b]) + self.low[b] * self.signs[a].sum(axis=1)
        estimate = product / root / f
        code_error = (1 - np.minimum(f, 1) ** 2) / f**2 / max(1, self.width - 1)
        step_error = (self.step[b] / f) ** 2 / 12
        return estimate + SURE * np.sqrt(code_error + step_error)


def unit_rows(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (row numbers, unit vectors)} of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    sizes, out = np.diff(ends), {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        part = flat[ends[rows][:, None] + np.arange(d)[None, :]]
        part = part / np.abs(part).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
        out[d] = rows, part / np.linalg.norm(part, axis=1, keepdims=True)
    return out


def _cosines(a, b) -> np.ndarray:
    """Row by row cosines of two Arrow list columns; -1 where the lengths differ."""
    out = np.full(len(a), -1.0)
    left, right = unit_rows(a), unit_rows(b)
    for d, (rows, units) in left.items():
        if d in right:
            _, here, there = np.intersect1d(rows, right[d][0], assume_unique=True, return_indices=True)
            out[rows[here]] = np.einsum("ij,ij->i", units[here], right[d][1][there])
    return out


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1, 1))


def _signs(points: DataFrame, settings: dict[int, tuple[int, int]]) -> DataFrame:
    """node, cells (one per table), pack."""

    def run(batches):
        for batch in batches:
            cells: list = [None] * len(batch)
            packs: list = [None] * len(batch)
            for d, (rows, units) in unit_rows(batch.column(1)).items():
                turns, n_tables = settings[d]
                found = np.zeros((len(rows), n_tables), np.uint64)
                for t in range(n_tables):
                    value = np.full(len(rows), d * 1_000_003 + t, np.uint64)
                    for k in range(turns):
                        value = value * np.uint64(0x9E3779B97F4A7C15) + corner(rotate(units, 1 + t * turns + k)).astype(np.uint64)
                        value ^= value >> np.uint64(29)
                    found[:, t] = value * np.uint64(0xBF58476D1CE4E5B9)
                for row, own, pack in zip(rows.tolist(), found.view(np.int64), codes(units), strict=True):
                    cells[row], packs[row] = own, pack
            columns = [batch.column(0), pa.array(cells, pa.list_(pa.int64())), pa.array(packs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "cells", "pack"])

    return saved(points.select("node", "v").mapInArrow(run, "node long, cells array<long>, pack binary"), "vector-signs")


def _balls(points: DataFrame, signs: DataFrame, half: float) -> DataFrame:
    """node, unit (negative: a ball), angle of the members of balls; centre c of a ball is node -1 - unit."""
    found = None
    for _ in range(CROWD_ROUNDS):
        free = signs.select("node", "cells")
        if found is not None:
            free = free.join(found.select("node"), "node", "left_anti")
        rows = free.select("node", F.explode("cells").alias("cell"))
        crowds = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).filter(F.col("n") >= CROWD)
        crowds = saved(crowds, "crowds")
        if crowds.isEmpty():
            break
        crowds = crowds.withColumn("size", F.col("n"))
        inside = rows.join(crowds.select("cell"), "cell", "left_semi")
        best = attach(inside, crowds, "cell", "n").groupBy("node").agg(F.max_by("centre", F.struct("size", "cell")).alias("centre"))
        best = saved(best, "crowd-rows")
        centres = best.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))
        centres = centres.join(points.select(F.col("node").alias("centre"), F.col("v").alias("w")), "centre")
        pairs = attach(best, centres, "centre", "n").join(points.select("node", "v"), "node").select("node", "centre", "v", "w")

        def run(batches):
            for batch in batches:
                angle = _angle(_cosines(batch.column(2), batch.column(3)))
                near = angle <= half
                unit = -1 - batch.column(1).to_numpy()[near]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), pa.array(unit), pa.array(angle[near])], ["node", "unit", "angle"])

        new = pairs.mapInArrow(run, "node long, unit long, angle double")
        found = saved(new if found is None else found.union(new), "balls")
    if found is None:
        found = points.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("unit"), F.lit(0.0).alias("angle"))
    return found


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """For each row the end of its run of equal keys."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    starts = np.concatenate([[0], np.flatnonzero(change)]) if n else np.empty(0, np.int64)
    return np.repeat(np.concatenate([starts[1:], [n]]), np.diff(np.concatenate([starts, [n]]))) if n else starts


def _estimated(cells: DataFrame, limits: tuple[float, float, float]) -> DataFrame:
    """Pairs of units (a, b) of a cell that need an exact look.

    ``cells``: cell, unit, pack. ``limits``: cosines that count for two vectors, a vector
    and a ball, two balls.
    """
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    big = saved(sizes.filter(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "big-cells")
    rows = cells.join(big, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "unit", "pack")
    ready = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "own", "unit")

    def block(table):
        """Pairs of whole runs of (cell, i, j)."""
        cell, i, j, own, unit = (table.column(k).to_numpy() for k in range(5))
        ends, out = _runs([cell, i, j]), [np.empty((0, 2), np.int64)]
        packs = table.column(5).to_pylist()
        after = ends - np.arange(len(cell)) - 1
        lengths = np.array([len(p) for p in packs])
        upto, at = np.cumsum(after), 0
        opened = {size: (rows, Codes([packs[r] for r in rows])) for size in np.unique(lengths).tolist() for rows in [np.flatnonzero(lengths == size)]}
        while at < len(cell):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            n = after[at:stop]
            a = np.repeat(np.arange(at, stop), n)
            b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            good = ((i[a] == j[a]) | (own[a] != own[b])) & (unit[a] != unit[b]) & (lengths[a] == lengths[b])
            a, b = a[good], b[good]
            for size, (rows, coded) in opened.items():
                mine = np.flatnonzero(lengths[a] == size)
                x, y = a[mine], b[mine]
                limit = np.take(np.array(limits), (unit[x] < 0).astype(int) + (unit[y] < 0))
                place = np.searchsorted(rows, np.arange(len(cell)))
                keep = coded.most(place[x], place[y]) >= limit
                out.append(np.stack([np.minimum(unit[x], unit[y])[keep], np.maximum(unit[x], unit[y])[keep]], axis=1))
            at = stop
        return np.unique(np.concatenate(out), axis=0)

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            table = table.combine_chunks()
            ends = _runs([table.column(k).to_numpy() for k in range(3)])
            whole = int(np.searchsorted(ends, len(ends))) if len(ends) else 0  # rows before the last run, which may go on
            held = table.slice(whole)
            if whole:
                pairs = block(table.slice(0, whole).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        if held is not None and len(held):
            pairs = block(held.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return saved(ready.mapInArrow(run, "a long, b long").distinct(), "unit-pairs")


def _with_members(unsure: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, unit, links) of nodes (node, unit, v) against every member of the ball ``unit``, in blocks."""
    cut = lambda rows, name: rows.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    few = members.join(unsure.select("unit").distinct(), "unit", "left_semi")
    cuts = saved(cut(few, "blocks").join(cut(unsure, "parts"), "unit"), "ball-cuts")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = few.join(cuts, "unit").select("unit", own("blocks").alias("block"), each("parts").alias("part"), F.lit(0).alias("role"), "node", "v")
    right = unsure.join(cuts, "unit").select("unit", each("blocks").alias("block"), own("parts").alias("part"), F.lit(1).alias("role"), "node", "v")
    task = ["unit", "block", "part"]
    ready = left.union(right).repartition(*task).sortWithinPartitions(*task, "role")

    def run(batches):
        at, centres = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            role, node, out = batch.column(3).to_numpy(), batch.column(4).to_numpy(), []
            units = {int(r): u for rows, part in unit_rows(batch.column(5)).values() for r, u in zip(rows, part, strict=True)}
            first = 0
            while first < len(keys):
                last = first
                while last < len(keys) and keys[last] == keys[first]:
                    last += 1
                if keys[first] != at:
                    at, centres = keys[first], []
                rows = np.arange(first, last)
                centres += [units[r] for r in rows[role[rows] == 0].tolist()]
                mine = rows[role[rows] == 1]
                if len(mine) and centres:
                    links = (np.stack([units[r] for r in mine.tolist()]) @ np.stack(centres).T >= threshold).sum(axis=1)
                    out.append((node[mine], np.full(len(mine), at[0]), links))
                first = last
            parts = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], ["node", "unit", "links"])

    return ready.mapInArrow(run, "node long, unit long, links long").filter("links > 0")


def links(
    table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id."""
    good = finite(vector_column) & F.exists(vector_column, lambda x: x != 0)
    rows = table.select(F.col(id_column).alias("vec_id"), F.when(good, F.col(vector_column)).alias("v"))
    every = saved(rows.withColumn("node", F.monotonically_increasing_id()), "vectors")
    points = every.filter("v IS NOT NULL").select("node", "vec_id", "v")
    widths = {r["d"]: r["n"] for r in points.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    padded = lambda d: max(2, 1 << (d - 1).bit_length())
    settings = {d: tables(padded(d), n, threshold, recall) for d, n in widths.items()}
    full = math.acos(threshold)
    signs = _signs(points, settings)
    balls = _balls(points, signs, (full - SLACK) / 2)
    home = signs.join(balls, "node", "left").withColumn("unit", F.coalesce("unit", "node"))
    home = saved(home.select("node", "unit", F.coalesce("angle", F.lit(0.0)).alias("angle"), "cells", "pack"), "unit-rows")
    sizes = home.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    crowd = saved(sizes.filter("unit < 0").withColumn("centre", -1 - F.col("unit")), "ball-sizes")
    # cells: a single vector's own rows; a ball once in each cell that has a member
    single = home.filter("unit >= 0").select(F.explode("cells").alias("cell"), "unit", "pack")
    packs = crowd.join(signs.select(F.col("node").alias("centre"), "pack"), "centre").select("unit", "pack")
    of_ball = home.filter("unit < 0").select(F.explode("cells").alias("cell"), "unit").distinct().join(packs, "unit").select("cell", "unit", "pack")
    limits = tuple(math.cos(min(math.pi, full * (1 + k / 2))) for k in range(3))
    pairs = _estimated(single.union(of_ball), limits)
    # exact: every member of a unit against the other unit's centre
    both = pairs.select(F.col("a").alias("unit"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    centre = points.join(pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct().select("u", F.when(F.col("u") < 0, -1 - F.col("u")).otherwise(F.col("u")).alias("node")), "node")
    centre = centre.select(F.col("u").alias("other"), F.col("v").alias("w")).join(crowd.select(F.col("unit").alias("other"), "n", "radius"), "other", "left")
    asked = both.join(centre, "other")
    counts = sizes.select("unit", "n").join(both.select("unit").distinct(), "unit", "left_semi")
    members = home.select("node", "unit").join(both.select("unit").distinct(), "unit", "left_semi").join(points.select("node", "v"), "node")
    met = spread_join(members, asked, "unit", "node", saved(counts, "unit-counts")).select("node", "unit", "other", "v", "w", "n", "radius")

    def decide(batches):
        for batch in batches:
            cosine = _cosines(batch.column("v"), batch.column("w"))
            ball = batch.column("other").to_numpy() < 0
            radius = batch.column("radius").fill_null(0.0).to_numpy(zero_copy_only=False)
            weight = batch.column("n").fill_null(1).to_numpy(zero_copy_only=False)
            angle = _angle(cosine)
            sure = np.where(ball, angle + radius <= full - SLACK, cosine >= threshold)
            unsure = ball & ~sure & (angle - radius <= full + SLACK)
            keep = pa.array(sure | unsure)
            found = np.where(sure, weight, 0).astype(np.int64)[sure | unsure]
            vectors = batch.column("v").filter(keep)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("node", "unit", "other")] + [pa.array(found), vectors], ["node", "unit", "other", "links", "v"])

    kind = points.schema["v"].dataType.simpleString()
    seen = saved(met.mapInArrow(decide, f"node long, unit long, other long, links long, v {kind}"), "vector-links")
    unsure = seen.filter("links = 0").select("node", F.col("other").alias("unit"), "v")
    of_members = home.filter("unit < 0").select("node", "unit").join(points.select("node", "v"), "node")
    compared = saved(_with_members(unsure, of_members, threshold), "member-links")
    compared = compared.groupBy("node", F.col("unit").alias("other")).agg(F.sum("links").alias("links"))
    own_unit = seen.filter("links = 0").select("node", "unit", "other")
    confirmed = seen.filter("links > 0").select("node", "unit", "other", "links")
    confirmed = saved(confirmed.unionByName(compared.join(own_unit, ["node", "other"]).select("node", "unit", "other", "links")), "confirmed")
    outside = confirmed.groupBy("node").agg(F.sum("links").alias("outside"))
    label = components(confirmed.select(F.least("unit", "other").alias("a"), F.greatest("unit", "other").alias("b")).distinct())
    labelled = attach_units(home.select("node", "unit"), crowd, label)
    out = every.select("node", "vec_id").join(labelled, "node", "left").join(outside, "node", "left")
    out = saved(out.select("vec_id", "label", (F.coalesce("inside", F.lit(0)) + F.coalesce("outside", F.lit(0))).alias("n_links")), "link-counts")
    linked = out.filter("label IS NOT NULL")
    least = saved(linked.groupBy("label").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "component-ids")
    alone = out.filter("label IS NULL").withColumn("component_id", F.col("vec_id"))
    return attach(linked, least, "label", "n").unionByName(alone).select("vec_id", "n_links", "component_id")


def attach_units(home: DataFrame, crowd: DataFrame, label: DataFrame) -> DataFrame:
    """node, label (NULL for a unit of one vector without links), inside (links within the node's ball)."""
    balls = crowd.join(label.select(F.col("node").alias("unit"), "label"), "unit", "left")
    balls = balls.select("unit", F.coalesce("label", "unit").alias("label"), (F.col("n") - 1).alias("inside"), "n")
    of_balls = attach(home.filter("unit < 0"), saved(balls, "ball-labels"), "unit", "n").select("node", "label", "inside")
    of_singles = home.filter("unit >= 0").join(label.select(F.col("node").alias("unit"), "label"), "unit").select("node", "label", F.lit(0).cast("long").alias("inside"))
    return of_balls.union(of_singles)


def query(spark, sf_dir: str) -> DataFrame:
    found = links(load(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = f"""WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS x FROM embeddings),
l AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM v AS a JOIN v AS b ON len(a.x) = len(b.x) AND a.rid <> b.rid
  WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
reached AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.b FROM reached AS r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.rid) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN (SELECT a AS rid, min(o.vec_id) AS component_id FROM reached JOIN v AS o ON o.rid = b GROUP BY a) USING (rid)
"""

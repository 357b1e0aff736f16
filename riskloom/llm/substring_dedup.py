"""Suffix-array dedup: bytes covered by a repeated string of LENGTH bytes go.

A position is removed if it lies in a LENGTH-byte string that starts anywhere else
too. Whether the string at a position repeats is the common prefix of its suffix
with a neighbour in suffix order. The order is never built for the whole corpus; it
is induced, from few seeds, for the suffixes that can matter:

1. *Seeds.* Of the GRAM-byte strings inside a LENGTH-byte string the one with the
   least hash (leftmost of equals) is its seed. Equal strings have equal seeds at
   equal places. Consecutive positions with one seed form a block. Blocks whose
   seed occurs nowhere else hold no repeat and go (a count per seed and a semi join).
2. *Names.* Blocks with equal bytes get one name, as in the recursion of induced
   sorting. A name that occurs twice or more repeats at all its positions. Only the
   others, and one block of each name beside them, go on.
3. *Induction.* Their bytes are dealt out by seed and sorted by the suffix that
   starts at the seed (Spark's external sort, which spills to disk, is the queue).
   A task holds the suffix tuples of a run of seeds, the common-prefix values of
   neighbours, and induces the order one byte further left at a time: a stable
   distribution by the preceding byte; the common prefix of two new neighbours is one
   more than the least value between them before. A position whose value reaches
   LENGTH repeats.
4. Seeds with more than MAX_SHARD different blocks are not dealt to one task: their
   positions are named one by one (128 bits of hash) and counted, which gives the
   same result without holding the seed's blocks together.

Hashes: seeds only prune, so that a collision costs time, never a result; names and
step 4 compare 128 bits.

Defined results: NULL and empty texts have no bytes; texts below LENGTH bytes keep
all; repeated rows are occurrences of their own, hence repeat each other; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textnum as T
from riskloom.llm.common import load, row_key, saved, text_or_empty

LENGTH = 200
GRAM = 50
MAX_SHARD = 20_000
SLICE = 1 << 18  # positions hashed at a time
_LOW = T.U64((1 << 20) - 1)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, in linear time."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, T.U64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def blocks(text: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(seed hash, name 1, name 2, first, last, seed position) arrays of a text's blocks."""
    found = []
    grams_hash, name_1, name_2 = T.span_hash(31), T.span_hash(32), T.span_hash(33)
    for at in range(0, len(text) - length + 1, SLICE):
        part = text[at : at + SLICE + length - 1]
        n = len(part) - length + 1
        starts = np.arange(len(part) - gram + 1)
        seeds = grams_hash.spans(grams_hash.prefix(part), starts, starts + gram)
        least = _window_min((seeds & ~_LOW) | starts.astype(T.U64), length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        place = (least[first] & _LOW).astype(np.int64)
        spans = [h.spans(h.prefix(part), first, last + length) for h in (name_1, name_2)]
        found.append((seeds[place], *spans, first + at, last + at, place + at))
    if not found:
        return (np.empty(0, T.U64),) * 3 + (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_BLOCK = "key binary, seed long, name1 long, name2 long, first int, last int, place int"


def _block_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys, parts = batch.column(0).to_pylist(), []
            for key, text in zip(keys, T.byte_rows(batch.column(1)), strict=True):
                found = blocks(text, length, gram)
                if len(found[0]):
                    parts.append((key, found))
            if parts:
                size = [len(f[0]) for _, f in parts]
                owner = pa.array(np.repeat(np.arange(len(parts)), size)).cast(pa.int32())
                key = pa.array([k for k, _ in parts], pa.binary()).take(owner)
                flat = [np.concatenate([f[i] for _, f in parts]) for i in range(6)]
                longs = [pa.array(x.view(np.int64)) for x in flat[:3]]
                ints = [pa.array(x.astype(np.int32)) for x in flat[3:]]
                yield pa.RecordBatch.from_arrays([key, *longs, *ints], [c.split()[0] for c in _BLOCK.split(", ")])

    return rows.mapInArrow(run, _BLOCK)


def induce(texts: list[bytes], place: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For sorted suffixes at seeds: which positions left of the seeds repeat.

    ``texts[i]`` holds a block's bytes, its seed at ``place[i]``; rows come in the order
    of the suffix at the seed. Returns a boolean matrix: row i, column t is the
    position t bytes left of the seed (columns beyond ``place[i]`` are False).
    """
    n, reach = len(texts), length - gram
    # columns: ``reach`` bytes left of the seed, ``length`` bytes from the seed on
    width = reach + length
    cells = np.zeros((n, width), np.uint8)
    right = np.empty(n, np.int64)
    for i, text in enumerate(texts):
        row = np.frombuffer(text, np.uint8)[: place[i] + length]
        cells[i, reach - place[i] : reach - place[i] + len(row)] = row
        right[i] = len(row) - place[i]
    repeats = np.zeros((n, reach + 1), bool)
    order = np.arange(n)
    if n < 2:
        return repeats
    same = cells[1:, reach:] == cells[:-1, reach:]
    common = np.where(same.all(1), length, same.argmin(1))
    common = np.minimum(common, np.minimum(right[1:], right[:-1]))  # with the row before
    lcp = np.concatenate([[0], common]).astype(np.int16)
    for t in range(reach + 1):
        if t:
            alive = place[order] >= t
            rank = np.flatnonzero(alive)
            if len(rank) < 2:
                break
            byte = cells[order[rank], reach - t]
            by_byte = np.argsort(byte, kind="stable")
            new_rank, new_byte = rank[by_byte], byte[by_byte]
            lcp = _induced(lcp, new_rank, new_byte)
            order = order[new_rank]
        enough = lcp >= length
        hit = enough.copy()
        hit[:-1] |= enough[1:]
        repeats[order[hit], t] = True
    return repeats


def _induced(lcp: np.ndarray, rank: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours after a stable distribution by the preceding byte."""
    table, step = [lcp], 1  # table[k][i]: least of lcp[i : i + 2**k]
    while 2 * step <= len(lcp):
        table.append(np.minimum(table[-1][: len(table[-1]) - step], table[-1][step:]))
        step *= 2
    out = np.zeros(len(rank), lcp.dtype)
    pair = np.flatnonzero(byte[1:] == byte[:-1]) + 1
    low, high = rank[pair - 1] + 1, rank[pair] + 1  # values low .. high - 1 lie between the two
    level = np.frexp((high - low).astype(float))[1] - 1
    for k in np.unique(level):
        at = level == k
        row = table[k]
        out[pair[at]] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))]) + 1
    return out


def _induced_rows(ready: DataFrame, length: int, gram: int, hold: int = 20_000) -> DataFrame:
    """Streams blocks sorted by (seed, suffix at the seed) and yields repeated ranges."""

    def run(batches):
        held: list[tuple] = []

        def flush(rows):
            place = np.array([r[3] - r[2] for r in rows], np.int64)
            clipped = np.minimum(place, length - gram)
            found = induce([r[4] for r in rows], clipped, length, gram)
            out = []
            for row, hits in zip(rows, found, strict=True):
                key, first, place_at, last = row[1], row[2], row[3], row[5]
                if not row[6]:
                    continue  # stands for a name that repeats anyway
                at = place_at - np.flatnonzero(hits)[::-1]
                at = at[(at >= first) & (at <= last)]
                if len(at):
                    cut = np.flatnonzero(np.diff(at) > 1)
                    for a, b in zip(np.concatenate([[at[0]], at[cut + 1]]), np.concatenate([at[cut], [at[-1]]]), strict=True):
                        out.append((key, int(a), int(b)))
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())],
                ["key", "first", "last"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= hold and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return ready.mapInArrow(run, "key binary, first int, last int")


def _split_rows(wide: DataFrame, length: int) -> DataFrame:
    """Every position of a block with the 128-bit name of its string."""

    def run(batches):
        name_1, name_2 = T.span_hash(34), T.span_hash(35)
        for batch in batches:
            keys, seeds, firsts, texts, lasts, owns = (batch.column(c).to_pylist() for c in ("key", "seed", "first", "bytes", "last", "own"))
            for key, seed, first, text, last, own in zip(keys, seeds, firsts, texts, lasts, owns, strict=True):
                n = last - first + 1
                part = np.frombuffer(text, np.uint8)
                starts = np.arange(n)
                names = [pa.array(h.spans(h.prefix(part), starts, starts + length).view(np.int64)) for h in (name_1, name_2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.binary()), pa.array([seed] * n), pa.array((starts + first).astype(np.int32)), pa.array([own] * n), *names],
                    ["key", "seed", "at", "own", "p1", "p2"],
                )

    return wide.mapInArrow(run, "key binary, seed long, at int, own boolean, p1 long, p2 long")


def _with_bytes(chosen: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Adds each block's bytes, [first, max(last, place) + length) as far as the text goes."""
    listed = chosen.groupBy("key").agg(F.collect_list(F.struct("seed", "first", "place", "last", "own")).alias("list"))
    both = rows.join(listed, "key")

    def run(batches):
        for batch in batches:
            found = []
            for key, text, items in zip(batch.column(0).to_pylist(), T.byte_rows(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for b in items:
                    stop = max(b["last"], b["place"]) + length
                    found.append((b["seed"], key, b["first"], b["place"], text[b["first"] : stop].tobytes(), b["last"], b["own"]))
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["seed", "key", "first", "place", "bytes", "last", "own"]
            )

    out = "seed long, key binary, first int, place int, bytes binary, last int, own boolean"
    return both.select("key", "text", "list").mapInArrow(run, out)


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_shard: int = MAX_SHARD) -> DataFrame:
    """key, first, last: ranges of positions whose string of ``length`` bytes repeats.

    Rows that are equal in id and text share a key (each is an occurrence).
    """
    rows = docs.select(row_key().alias("key"), text_or_empty().alias("text"))
    parsed = _block_rows(rows, length, gram)
    often = parsed.select("seed").groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    kept = saved(parsed.join(often, "seed", "left_semi"), "repeated-seeds")
    one = F.struct("key", "first", "place", "last")
    names = saved(kept.groupBy("seed", "name1", "name2").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")), "block-names")
    whole = kept.join(names.filter("n > 1"), ["seed", "name1", "name2"], "left_semi").select("key", "first", "last")
    variety = names.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.col("n") == 1).alias("open")).filter("kinds > 1 AND open")
    chosen = names.join(variety, "seed").select("seed", "kinds", "one.*", (F.col("n") == 1).alias("own"))
    # rows of a key that occurs several times have all their names twice: nothing of theirs is open
    distinct_rows = rows.dropDuplicates(["key"])
    chosen = saved(chosen, "open-blocks")
    withbytes = saved(_with_bytes(chosen.filter(F.col("kinds") <= max_shard), distinct_rows, length), "open-bytes")
    suffix = F.expr(f"substring(bytes, place - first + 1, {length})")
    ready = withbytes.repartition("seed").sortWithinPartitions("seed", suffix)
    parts = [whole, _induced_rows(ready, length, gram)]
    wide = chosen.filter(F.col("kinds") > max_shard)
    if not wide.isEmpty():
        each = saved(_split_rows(_with_bytes(wide, distinct_rows, length), length), "wide-positions")
        again = each.groupBy("seed", "p1", "p2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        hit = each.join(again, ["seed", "p1", "p2"], "left_semi").filter("own")
        parts.append(hit.select("key", F.col("at").alias("first"), F.col("at").alias("last")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def removed_spans(firsts: np.ndarray, lasts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes covered by the strings that start in the ranges."""
    order = np.argsort(firsts, kind="stable")
    start, stop = firsts[order].astype(np.int64), np.maximum.accumulate(lasts[order].astype(np.int64)) + length
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    return list(zip(start[new].tolist(), np.concatenate([stop[new[1:] - 1], stop[-1:]]).tolist(), strict=True))


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_shard: int = MAX_SHARD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans."""
    marks = repeated(docs, length, gram, max_shard).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), row_key().alias("key")).join(marks, "key", "left").select("doc_id", "text", "marks")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            marks = batch.column(2)
            offsets = marks.offsets.to_numpy()
            first, last = (marks.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, text in enumerate(T.byte_rows(batch.column(1))):
                a, b = offsets[i], offsets[i + 1]
                spans = removed_spans(first[a:b], last[a:b], length) if b > a else []
                kept, at = [], 0
                for start, stop in spans:
                    kept.append(text[at:start].tobytes())
                    at = stop
                kept = b"".join([*kept, text[at:].tobytes()])
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": s, "stop": e} for s, e in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
            )

    return rows.mapInArrow(
        run,
        f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,stop:long>>",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return cut(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

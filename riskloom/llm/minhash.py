"""MinHash near-duplicates: BagMinHash signatures, banding, exact multiset overlap.

A text is the multiset of its runs of five words (a shorter text with words is one
run). Every element owns Poisson processes over (time, weight): one on the weight
interval [0, 1) and one on each dyadic interval [2**(l-1), 2**l), all seeded by the
element alone. A text of multiplicity w takes the points below w. Each point falls
into one of M registers; a register keeps its earliest point. Two registers agree
with probability sum(min) / sum(max), the weighted Jaccard similarity. As the
process is cut at the time by which all registers are filled, a text costs one
point per element plus O(M log M).

Equal texts are merged first, so everything below works on distinct texts. Bands of
ROWS registers give buckets. Texts that reach THRESHOLD by exact multiset overlap are
linked, links are closed to components, labelled by their least text.

1. Every text meets the least text of each of its buckets, if their sketches (one byte
   of each register) agree in enough registers (:func:`agreeing`).
2. Texts of a bucket that have different labels share a cluster (:func:`_clusters`). The
   texts of a small cluster that lack its most common label meet all of it; of a
   large one all meet DRAWN centres drawn from it.
3. Texts of a large cluster that still lack its most common label meet all of it.

No link between two texts of a bucket is lost: of two labels one is not the most common.
Tasks hold a block of centres and return a spanning forest of the labels they join,
never all pairs of a group. A group of n near copies costs n comparisons with a block
of drawn centres, and n more for each block of texts that are truly apart from it.
Signatures miss a pair of similarity 0.8 with probability (1 - 0.8**5)**28 < 2e-5; what
the sketches of the first step miss, the later steps compare exactly.

Defined results: NULL counts as empty text; texts without words are equal only to
the same text; repeated rows are in one class; an empty table gives an empty
result; columns other than id and text are not read. A class's id is its least id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import textnum as T
from riskloom.llm.common import discard, fresh, load, saved, small_batches, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
ROWS = 5
BANDS = 28
REGISTERS = ROWS * BANDS
DRAWN = 256  # centres drawn from a large cluster
BLOCK_BYTES = 1 << 20  # texts of the centres that a task holds, about
PART_BYTES = 2 << 20  # texts of the members that a task streams over, about
U64 = np.uint64


def shingles(text: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (ascending) and their multiplicities."""
    starts, ends = T.word_bounds(text)
    if not len(starts):
        return np.empty(0, U64), np.empty(0, np.int64)
    words = T.word_hashes(text, starts, ends, salt=7)
    return np.unique(T.windows(words, min(size, len(words))), return_counts=True)


def _uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((seed >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gaps(seed: np.ndarray) -> np.ndarray:
    return -np.log(_uniform(seed))


def _processes(owner: np.ndarray, elements: np.ndarray, counts: np.ndarray):
    """(owner, seed, rate, lower weight, multiplicity) of the elements' Poisson processes.

    Level 0 covers the weights [0, 1), level l >= 1 covers [2**(l-1), 2**l).
    """
    out = [(owner, T.mix(elements), np.ones(len(elements)), np.zeros(len(elements)), counts)]
    level, low = 1, 1
    while (more := counts > low).any():
        seed = T.mix(elements[more] + U64(level * 0x9E3779B97F4A7C15 % 2**64))
        side = np.full(len(seed), float(low))
        out.append((owner[more], seed, side, side, counts[more]))
        level, low = level + 1, low * 2
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def bag_minhash_many(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Signatures of weighted sets: per set and register the name of the earliest point (uint64)."""
    out = np.zeros((len(sets), registers), U64)
    todo = [i for i, (e, _) in enumerate(sets) if len(e)]
    scale = registers * (math.log(registers) + 4)
    while todo:
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        elements, counts = (np.concatenate([sets[i][k] for i in todo]) for k in (0, 1))
        stops = scale / np.bincount(owner, counts)
        o, s, r, b, top = _processes(owner, elements, counts)
        plain = not b.any()  # every multiplicity is 1: all points count
        stop, found, k = stops[o], [], 1
        t = _gaps(s) / r
        live = np.flatnonzero(t < stop)
        t = t[live]
        while len(live):  # all processes that may have more points take their next ones
            seed = s[live]
            name = T.mix(seed * U64(0xA0761D6478BD642F) + U64(k))
            if plain:
                found.append((t, o[live], name))
            else:
                fits = np.ones(len(live), bool)
                high = np.flatnonzero(b[live] > 0)
                at = live[high]
                fits[high] = b[at] + r[at] * _uniform(T.mix(name[high] + U64(5))) < top[at]
                found.append((t[fits], o[live[fits]], name[fits]))
            k += 1
            step = _gaps(T.mix(seed + U64(k * 0xD1B54A32D192ED03 % 2**64)))
            t = t + (step if plain else step / r[live])
            go = t < stop[live]
            t, live = t[go], live[go]
        time, o, name = map(np.concatenate, zip(*found, strict=True))
        cell = o * registers + (name % U64(registers)).astype(np.int64)
        earliest = np.full(len(todo) * registers, np.inf)
        np.minimum.at(earliest, cell, time)
        first = time == earliest[cell]
        flat = np.zeros(len(todo) * registers, U64)
        flat[cell[first]] = name[first]
        filled = np.isfinite(earliest)
        done = filled.reshape(-1, registers).all(1)
        for j, i in enumerate(todo):
            if done[j]:
                out[i] = flat[j * registers : (j + 1) * registers]
        todo, scale = [i for j, i in enumerate(todo) if not done[j]], scale * 2
    return out


def bag_minhash(elements: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    return bag_minhash_many([(elements, counts)], registers)[0]


def band_hashes(signature: np.ndarray) -> np.ndarray:
    return T.windows(signature, ROWS)[::ROWS] ^ T.mix(np.arange(BANDS, dtype=U64))


def agreeing(threshold: float) -> int:
    """Sketch bytes that two texts must share to be compared: five standard deviations below the mean at the threshold."""
    return int(REGISTERS * threshold - 5 * math.sqrt(REGISTERS * threshold * (1 - threshold)))


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text and node, the 16-byte name of the text."""
    return docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"), name_of(text_column).alias("node"))


def name_of(text_column: str = "text"):
    return F.unhex(F.md5(text_or_empty(text_column)))


def signatures(texts: DataFrame) -> DataFrame:
    """node, bands, sketch per row; texts without words have no bands."""

    def run(batches):
        for batch in batches:
            bands, sketches, held, size = [], [], [], 0

            def flush(held):
                signed = bag_minhash_many(held)
                bands.extend(band_hashes(g).view(np.int64) if len(e) else np.empty(0, np.int64) for g, (e, _) in zip(signed, held, strict=True))
                sketches.extend(row.tobytes() for row in (signed >> U64(56)).astype(np.uint8))

            for text in T.byte_rows(batch.column(1)):
                held.append(shingles(text))
                size += len(held[-1][0])
                if len(held) >= 512 or size > 80_000:
                    flush(held)
                    held, size = [], 0
            flush(held)
            columns = [batch.column(0), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "bands", "sketch"])

    small_batches(texts.sparkSession)
    return texts.select("node", "text").mapInArrow(run, "node binary, bands array<long>, sketch binary")


def packed(texts: DataFrame) -> DataFrame:
    """node, pack (the compressed text), size (its bytes): texts cross the network several times."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            rows = list(T.byte_rows(batch.column(1)))
            packs = pa.array([codec.compress(row, asbytes=True) for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packs, pa.array([len(row) for row in rows], pa.int64())], ["node", "pack", "size"])

    return texts.select("node", "text").mapInArrow(run, "node binary, pack binary, size long")


class HeldTexts:
    """Multisets of a block's centres with their labels; a member is compared with all of them at once."""

    def __init__(self, threshold: float):
        self.threshold, self.labels, self.sets, self.index, self.root = threshold, [], [], None, {}

    def add(self, label, text) -> None:
        self.labels.append(label)
        self.sets.append(shingles(text))

    def _top(self, label):
        while (up := self.root.get(label, label)) != label:
            self.root[label] = self.root.get(up, up)
            label = up
        return label

    def near(self, text) -> np.ndarray:
        """Positions of the centres whose similarity with the text reaches the threshold."""
        multiset = shingles(text)
        if self.index is None:
            element, count = (np.concatenate([s[k] for s in self.sets]) for k in (0, 1))
            order = np.argsort(element, kind="stable")
            owner = np.repeat(np.arange(len(self.sets)), [len(s[0]) for s in self.sets])
            self.index = element[order], count[order], owner[order], np.array([s[1].sum() for s in self.sets])
        element, count, owner, totals = self.index
        low, high = np.searchsorted(element, multiset[0], "left"), np.searchsorted(element, multiset[0], "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], np.minimum(count[at], np.repeat(multiset[1], n)), len(totals))
        union = totals + multiset[1].sum() - common
        return np.flatnonzero((common >= self.threshold * union - 1e-9) & (union > 0))

    def linked(self, label, text):
        """Labels to be joined with the member's that this block has not joined with it yet."""
        out = []
        for i in self.near(text):
            ours, its = self._top(label), self._top(self.labels[i])
            if ours != its:
                self.root[its] = ours
                out.append(self.labels[i])
        return out


def _links(centres: DataFrame, members: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between labels: every member against every centre of its cluster, by exact overlap.

    Both sides: cluster, node, label, distinct by cluster and node; ``pool``: node,
    pack, size. A cluster's centres are cut into blocks and its members into parts by
    the size of their texts; a task holds a block and streams over a part. It returns
    only links that join what it has not joined yet, fewer than it has labels.
    """
    size = pool.select("node", "size")
    cut = lambda rows, most, name: rows.join(size, "node").groupBy("cluster").agg((F.floor(F.sum("size") / most) + 1).cast("int").alias(name))
    cuts = saved(cut(centres, BLOCK_BYTES, "blocks").join(cut(members, PART_BYTES, "parts"), "cluster"), "cuts")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    left = centres.join(cuts, "cluster").select("cluster", own("blocks", 1).alias("block"), each("parts").alias("part"), F.lit(0).alias("role"), "node", "label")
    right = members.join(cuts, "cluster").select("cluster", each("blocks").alias("block"), own("parts", 2).alias("part"), F.lit(1).alias("role"), "node", "label")
    work = left.union(right).join(pool, "node")
    task = ["cluster", "block", "part"]
    ready = work.repartition(*task).sortWithinPartitions(*task, "role", "node")

    def run(batches):
        at, held, codec = None, None, pa.Codec("zstd")
        for batch in batches:
            clusters, blocks, parts, roles, labels, sizes = (batch.column(i).to_pylist() for i in range(6))
            found = []
            for *task, role, label, size, pack in zip(clusters, blocks, parts, roles, labels, sizes, T.byte_rows(batch.column(6)), strict=True):
                text = np.frombuffer(codec.decompress(pack, size), np.uint8)
                if task != at:
                    at, held = task, HeldTexts(threshold)
                if role == 0:
                    held.add(label, text)
                elif held.labels:
                    found.extend((other, label) for other in held.linked(label, text))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    out = saved(ready.select(*task, "role", "label", "size", "pack").mapInArrow(run, "a binary, b binary"), "links")
    discard(cuts)
    return out


def _alike(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The pairs (centre, node) whose sketches agree well enough."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
            keep = np.count_nonzero(a == b, axis=1) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    side = lambda c: sketches.select(F.col("node").alias(c), F.col("value").alias(f"of_{c}"))
    both = pairs.join(side("centre"), "centre").join(side("node"), "node").select("centre", "node", "of_centre", "of_node")
    return both.mapInArrow(run, "centre binary, node binary")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label (the least node of the component) for every node of a link.

    Each round points every node to the least label around it and then to that
    label's own label; rounds grow with the logarithm of a component's diameter in
    practice. Tables, not the driver, hold the labels.
    """
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label that learns of a lesser one passes it on to all nodes that carry it
        lesser = hooked.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("lesser"))
        shortcut = hooked.join(lesser, hooked["old"] == lesser["root"]).select("node", "old", F.least("label", "lesser").alias("label"))
        step = saved(shortcut, "labels")
        discard(labels)
        if step.filter("old <> label").isEmpty():
            discard(edges)
            out = step.select("node", "label")
            out.saved_at = step.saved_at
            return out
        labels = step
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after links (a, b) between labels; a node without a label is its own."""
    joined = components(links)
    discard(links)
    up = joined.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = label.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    new = up.join(label.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    out = saved(old.union(new), "labels")
    discard(joined)
    discard(label)
    return out


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the nodes' labels; a node without a label is its own."""
    return rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _mixed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, node, label) of the groups with several labels, with the most common one (main) and the group's size (n)."""
    parts = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    top = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
    return rows.join(top.filter("k > 1").drop("k"), keys)


def _clusters(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (cluster, node): every two texts of a bucket with different labels share a cluster.

    A bucket's cluster is the most common label of the largest bucket that one of its
    texts is in, so that the buckets of a group of near copies mostly have the same
    cluster, and a text stands in few clusters rather than in all of its buckets.
    """
    apart = saved(_mixed(_labelled(shared, label), ["value"]).select("value", "node", "n", "main"), "apart")
    home = apart.groupBy("node").agg(F.max(F.struct("n", "main")).alias("home"))
    cluster = apart.join(home, "node").groupBy("value").agg(F.max("home")["main"].alias("cluster"))
    out = saved(apart.join(cluster, "value").select("cluster", "node").distinct(), "clusters")
    discard(apart)
    return out


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, node (its text's name), label (its class's)."""
    texts = _texts(docs, id_column, text_column)
    signed = signatures(texts).groupBy("node").agg(F.first(F.struct("bands", "sketch")).alias("s"))
    names = saved(signed.select("node", "s.bands", "s.sketch"), "signatures")
    entries = names.select("node", F.explode("bands").alias("value"))  # a value tells its band, too
    buckets = entries.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("value")
    shared = saved(entries.join(buckets, "value"), "bucket-rows")
    mates = saved(shared.select("node").distinct(), "bucket-nodes")
    sketches = saved(names.select("node", F.col("sketch").alias("value")).join(mates, "node", "left_semi"), "sketches")
    discard(names)
    # 1. every text with the least of its buckets
    least = shared.groupBy("value").agg(F.min("node").alias("centre"))
    pairs = shared.join(least, "value").filter("node <> centre").select("centre", "node").distinct()
    pairs = saved(_alike(pairs, sketches, agreeing(threshold)), "pairs")
    discard(sketches)
    pool = saved(packed(texts).join(mates, "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    discard(mates)
    centres = pairs.select(F.col("centre").alias("cluster"), F.col("centre").alias("node"), F.col("centre").alias("label")).distinct()
    members = pairs.select(F.col("centre").alias("cluster"), "node", F.col("node").alias("label"))
    links = _links(centres, members, pool, threshold)
    discard(pairs)
    label = components(links)
    discard(links)
    # 2. what is still apart in a bucket: small clusters in full, large ones with centres drawn from them
    clusters = _clusters(shared, label)
    discard(shared)
    rows = saved(_mixed(_labelled(clusters, label), ["cluster"]), "cluster-rows")
    discard(clusters)
    drawn = F.pmod(F.xxhash64("node"), F.lit(2**30)) * F.col("n") < DRAWN * 2**30
    small = F.col("n") <= DRAWN
    label = _joined(label, _links(rows.filter((small & F.expr("label <> main")) | (~small & drawn)), rows, pool, threshold))
    # 3. what is still apart from most of a large cluster, with all of it
    last = saved(_mixed(_labelled(rows.filter(~small).select("cluster", "node"), label), ["cluster"]), "cluster-rows")
    discard(rows)
    label = _joined(label, _links(last.filter("label <> main"), last, pool, threshold))
    for done in (last, pool):
        discard(done)
    named = texts.select("doc_id", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = saved(named, "near-classes")
    ids = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(ids, "label").select("doc_id", "class_id", "class_size", "node", "label")


def _chosen(found: DataFrame) -> DataFrame:
    """label, best (struct of is-NULL, id, name of the text): the document of each class that stays."""
    return found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document; of rows with the kept id and text exactly one is kept."""
    found = saved(classes(load(spark, sf_dir, "documents")).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "row")).alias("best"))
    kept = first.select(F.col("best.row").alias("row"), F.lit(True).alias("kept"))
    out = found.join(kept, "row", "left")
    return out.select("doc_id", "class_id", "class_size", F.coalesce("kept", F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: least id first (NULL last), then the text's name; columns unchanged."""
    found = classes(docs)
    best = _chosen(found)
    doc, ident, node = fresh(docs, "_doc", "_id", "_node")
    best = best.select(F.coalesce(F.col("best.doc_id").cast("string"), F.lit("null")).alias(ident), F.col("best.node").alias(node))
    named = docs.select(
        F.struct(*docs.columns).alias(doc), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(ident), name_of().alias(node)
    )
    return named.join(best, [ident, node], "left_semi").dropDuplicates([ident, node]).select(f"{doc}.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays."""
    return keep_one(docs)

"""SentencePiece encoding and decoding with seeded merge-dropout.

Byte-pair merges run from an agenda (a priority queue of candidate merges, best
score first, then leftmost). A candidate that comes up is skipped if a keyed hash of
(seed, document id, the chunk's place in the text, its turn) falls below the dropout
rate: the same seed always gives the same pieces, every repeat of a word has coins of
its own, and every segmentation decodes to the text. Without dropout the pieces equal
the public library's.

As no vocabulary piece has a blank after another character, no merge crosses the
start of a chunk (blanks, then other characters). A bounded cache keeps the pieces of
(chunk, turns at which a candidate was skipped), which the coins of each occurrence
choose from; it changes the time, never a result.

Characters without a piece, and the blank sign itself if a text contains it, become
byte pieces. Defined results: NULL and empty texts have no pieces and decode to the
empty text; repeated rows get equal pieces; an empty table gives an empty result;
columns other than id and text pass through untouched.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from riskloom.llm.common import load

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 2
CACHE = 300_000  # runs kept by a worker, some 300 bytes each; idle workers hold them while other stages run
BLANK = "▁"
_CHUNK = re.compile(f" *[^ \n{BLANK}]+| +|\n|{BLANK}")


UNKNOWN, GONE = -1, -2  # symbols: a character without a piece; merged into an earlier symbol
NONE = np.iinfo(np.int32).max  # rank of a place without a candidate
LONG = 120  # characters above which a chunk is segmented by itself
TURNS = 64  # coins drawn ahead for an occurrence; a chunk with more turns is segmented by itself
KEPT = 20  # turns above which a run is not kept: equal skips hardly come again
BLOCK = 1 << 17  # occurrences that are looked up, and what is new of them segmented, at once
SALT_STEP = 0x9E3779B97F4A7C15
PAIR_STEP = 0xC2B2AE3D27D4EB4F


def _mix(x):
    """64 mixed bits (SplitMix64's last steps) of a number or of an array."""
    if isinstance(x, int):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _coin(salt: int, turn: int) -> int:
    """16 keyed bits for the candidate that comes up at this turn; four turns share a hash."""
    return _mix((salt + (turn // 4 + 1) * SALT_STEP) % 2**64) >> 16 * (turn % 4) & 0xFFFF


def _below(dropout: float) -> int:
    return round(dropout * 2**16)


def _struck(salts: np.ndarray, dropout: float) -> np.ndarray:
    """For each salt the first :data:`TURNS` turns whose coin says skip, as bits."""
    steps = np.array([(k + 1) * SALT_STEP % 2**64 for k in range(TURNS // 4)], np.uint64)
    out = [np.empty(0, np.uint64)]
    for at in range(0, len(salts), 4096):
        coins = np.ascontiguousarray(_mix(salts[at : at + 4096, None] + steps), "<u8").view("<u2")
        out.append(np.packbits(coins < _below(dropout), axis=1, bitorder="little").view("<u8").ravel())
    return np.concatenate(out)


class Vocabulary:
    """Pieces and merge order; small (one entry per piece), shipped with the task."""

    def __init__(self, model_path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(len(model)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.surface = [b""] * len(model)
        self.ids, self.order = {}, {}
        for i in range(len(model)):
            if i not in special:
                piece = model.id_to_piece(i).replace(BLANK, " ")
                self.ids[piece] = i
                self.order[piece] = -model.get_score(i)
                self.surface[i] = piece.encode()
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        if missing := {c for p in self.ids for c in p} - set(self.ids):
            raise ValueError(f"characters of pieces without a piece: {sorted(missing)[:3]}")
        self._tables()
        crossing = [p for p in self.ids if re.search("[^ ] ", p) or ("\n" in p and len(p) > 1)]
        if crossing:
            raise ValueError(f"pieces across chunks: {crossing[:3]}")

    def _tables(self) -> None:
        """Arrays for :meth:`segment_many`: characters, merge order of pieces, and pairs with their merged piece."""
        self.of_char = np.full(0x110000, UNKNOWN, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        scores = sorted(set(self.order.values()))
        place = {s: k for k, s in enumerate(scores)}  # equal scores stay equal: the leftmost merges first
        self.rank = np.full(len(self.surface), NONE, np.int32)
        pairs = {}
        for piece, i in self.ids.items():
            self.rank[i] = place[self.order[piece]]
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * len(self.surface) + right] = i
        # open addressing: slot of a key is its hash, the next free one if that is taken
        self.slots = 1 << (2 * len(pairs) - 1).bit_length() + 1
        self.slot_key = np.full(self.slots, -1, np.int64)
        self.slot_id = np.full(self.slots, UNKNOWN, np.int32)
        self.probes = 1
        for key, i in pairs.items():
            at, tries = key * PAIR_STEP % 2**64 >> 20 & self.slots - 1, 1
            while self.slot_key[at] >= 0:
                at, tries = at + 1 & self.slots - 1, tries + 1
            self.slot_key[at], self.slot_id[at], self.probes = key, i, max(self.probes, tries)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece of each pair of symbols, or UNKNOWN."""
        keys = left.astype(np.int64) * len(self.surface) + right
        keys[(left < 0) | (right < 0)] = -2
        at = (keys.view(np.uint64) * np.uint64(PAIR_STEP) >> np.uint64(20)).astype(np.int64) & self.slots - 1
        out = np.where(self.slot_key[at] == keys, self.slot_id[at], np.int32(UNKNOWN))
        rest = np.flatnonzero((self.slot_key[at] != keys) & (self.slot_key[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            at[rest] = at[rest] + 1 & self.slots - 1
            hit = self.slot_key[at[rest]] == keys[rest]
            out[rest[hit]] = self.slot_id[at[rest[hit]]]
            rest = rest[~hit & (self.slot_key[at[rest]] >= 0)]
        return out

    def segment(self, chunk: str, dropout: float = 0.0, key: int = 0) -> list[int]:
        """Piece ids of one chunk (blanks as blanks); ``key`` is the salt of its coins."""
        below, salt = _below(dropout), key % 2**64
        return self.run(chunk, (lambda turn: _coin(salt, turn) < below) if below else None)[0]

    def run(self, chunk: str, skip=None) -> tuple[list[int], int]:
        """Piece ids and the number of turns, by a heap as agenda; ``skip`` tells whether the candidate of a turn is skipped."""
        n, order = len(chunk), self.order
        if chunk == BLANK:
            return [self.byte_ids[b] for b in chunk.encode()], 0
        end = list(range(1, n + 1))  # of the symbol that starts here; 0: merged into an earlier one
        before = list(range(-1, n - 1))
        agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := order.get(chunk[i : i + 2])) is not None]
        heapify(agenda)
        turn = -1
        while agenda:
            _, i, m, e = heappop(agenda)
            if end[i] != m or end[m] != e:
                continue  # one of its symbols is gone or has grown
            turn += 1
            if skip is not None and skip(turn):
                continue
            end[i], end[m] = e, 0
            if e < n:
                before[e] = i
                f = end[e]
                if (r := order.get(chunk[i:f])) is not None:
                    heappush(agenda, (r, i, e, f))
            p = before[i]
            if p >= 0 and (r := order.get(chunk[p:e])) is not None:
                heappush(agenda, (r, p, i, e))
        out, i = [], 0
        while i < n:
            piece = chunk[i : end[i]]
            if (known := self.ids.get(piece)) is not None:
                out.append(known)
            else:
                out.extend(self.byte_ids[b] for b in piece.encode())
            i = end[i]
        return out, turn + 1

    def segment_many(self, chunks: list[str], dropout: float = 0.0, key: int = 0) -> list[bytes]:
        """As :meth:`segment`, for many chunks with the same salt: int32 ids of each as bytes."""
        salts = np.full(len(chunks), key % 2**64, np.uint64)
        runs = self.run_many(chunks, _struck(salts, dropout))
        slow = lambda k: np.array(self.segment(chunks[k], dropout, key), np.int32).tobytes()
        return [slow(k) if ids is None else ids for k, (ids, _) in enumerate(runs)]

    def run_many(self, chunks: list[str], struck: np.ndarray) -> list[tuple]:
        """As :meth:`run`, for many chunks in step: int32 ids of each as bytes, and its turns.

        ``struck`` has the turns that are skipped as bits. Every chunk has its agenda as
        a row of ranks; each step takes the first least rank of every row, and merges it
        or strikes it off. A run that could have more than :data:`TURNS` turns and skips
        any has no ids.
        """
        out: list = [(None, 0)] * len(chunks)
        lengths = np.array([len(c) for c in chunks])
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 20), (20, 40), (40, LONG)):
            at = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(at, -(-len(at) // 4096)) if len(at) else ():
                for i, run in zip(part.tolist(), self._in_step([chunks[i] for i in part], lengths[part], struck[part]), strict=True):
                    out[i] = run
        for i in np.flatnonzero((lengths > LONG) & (struck == 0)).tolist():
            ids, turns = self.run(chunks[i])
            out[i] = np.array(ids, np.int32).tobytes(), turns
        # beyond the bits nothing is known of the coins
        return [(None, turns) if turns > TURNS and s else (ids, turns) for (ids, turns), s in zip(out, struck.tolist(), strict=True)]

    def _in_step(self, chunks: list[str], lengths: np.ndarray, struck: np.ndarray) -> list[tuple]:
        n, width = len(chunks), int(lengths.max())
        inside = np.arange(width)[None, :] < lengths[:, None]
        codes = np.zeros((n, width), np.int64)
        codes[inside] = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        symbol = np.where(inside, self.of_char[codes], np.int32(GONE))
        any_struck, turn = bool(struck.any()), 0  # every row that still has a candidate is at the same turn
        turns = np.zeros(n, np.int64)
        end = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        merged = np.full((n, width), UNKNOWN, np.int32)
        merged[:, :-1] = self._merged(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width - 1)
        rank = np.where(merged >= 0, self.rank[merged], NONE)
        rows = np.arange(n)
        while len(rows):
            i = rank[rows].argmin(axis=1)
            some = rank[rows, i] != NONE
            rows, i = rows[some], i[some]
            r = rows
            turns[rows] = turn + 1
            if any_struck and turn < TURNS:
                go = struck[rows] >> np.uint64(turn) & np.uint64(1) == 0
                rank[rows[~go], i[~go]] = NONE
                r, i = rows[go], i[go]
            turn += 1
            m = end[r, i]
            e = end[r, m]
            piece = merged[r, i]
            symbol[r, i], symbol[r, m], end[r, i], rank[r, m] = piece, GONE, e, NONE
            more = e < lengths[r]
            rank[r, i] = NONE
            q, qi, qe = r[more], i[more], e[more]
            before[q, qe] = qi
            new = self._merged(piece[more], symbol[q, qe])
            merged[q, qi], rank[q, qi] = new, np.where(new >= 0, self.rank[new], NONE)
            p = before[r, i]
            has = p >= 0
            q, qp = r[has], p[has]
            new = self._merged(symbol[q, qp], piece[has])
            merged[q, qp], rank[q, qp] = new, np.where(new >= 0, self.rank[new], NONE)
        left = symbol != GONE
        flat = symbol[left].astype(np.int32).tobytes()
        stops = 4 * np.cumsum(left.sum(1))
        starts = np.concatenate([[0], stops[:-1]])
        out = [flat[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        for row in np.flatnonzero((symbol == UNKNOWN).any(1)).tolist():
            ids = []
            for k in np.flatnonzero(left[row]).tolist():
                known = int(symbol[row, k])
                ids.extend([known] if known >= 0 else [self.byte_ids[b] for b in chunks[row][k].encode()])
            out[row] = np.array(ids, np.int32).tobytes()
        return list(zip(out, turns.tolist(), strict=True))

    def same(self, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether the ids of each text decode to it; one take of pieces for all of them."""
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        taken = pa.array(self.surface, pa.large_binary()).take(pa.array(flat))
        places = np.frombuffer(taken.buffers()[1], np.int64)[: len(flat) + 1]
        data = memoryview(taken.buffers()[2] or b"")
        ends = np.cumsum([0, *map(len, ids)])
        starts = [int(places[at]) if len(flat) else 0 for at in ends]
        # the leading blank of the first chunk goes
        return [bytes(data[a + 1 : b]) == text.encode() for a, b, text in zip(starts[:-1], starts[1:], texts, strict=True)]

    def decode(self, ids) -> bytes:
        """UTF-8 text of piece ids (the leading blank of the first chunk goes)."""
        return b"".join(map(self.surface.__getitem__, ids))[1:]


class Encoder:
    """Whole texts to ids.

    Up to a skipped candidate, a run with skips is the run without; so a run depends on
    the turns it skips alone. ``known`` has runs met so far: (chunk, skipped turns as
    bits), or the chunk alone if it skips none, to the bits of all its turns and its ids.
    """

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int, cache: int = CACHE):
        self.vocabulary, self.dropout, self.seed, self.room = vocabulary, dropout, seed, cache
        self.known: dict = {}

    def salts(self, doc_id, n: int) -> np.ndarray:
        """A salt for each of the document's ``n`` chunks."""
        own = np.uint64(xxhash.xxh3_64_intdigest(str(doc_id).encode(), self.seed % 2**64))
        return _mix(own + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(SALT_STEP))

    def _ids(self, chunks: list[str], salts: np.ndarray) -> list[bytes]:
        known, new = self.known, []
        struck = _struck(salts, self.dropout) if self.dropout else np.zeros(len(chunks), np.uint64)
        index: dict = defaultdict()
        index.default_factory = index.__len__
        code = np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))
        names = list(index)
        runs = [known.get(c, (-1, b"")) for c in names]  # met no run without skips: every turn is unknown
        whole = np.array([bits for bits, _ in runs], np.int64).view(np.uint64)
        plain = np.empty(len(names), object)
        plain[:] = [ids for _, ids in runs]
        out = plain[code]
        # equal occurrences at once: what is skipped by one of the run's turns, or of an unknown chunk
        rest = np.flatnonzero((struck & whole[code] != 0) | (whole == np.uint64(2**64 - 1))[code])
        if not len(rest):
            return out.tolist()
        own, mine = code[rest], struck[rest]
        lengths = np.array(list(map(len, names)))[own]
        # what lies behind the last possible turn makes no difference
        possible = np.minimum(TURNS, lengths - 1 + np.bitwise_count(mine)).astype(np.uint64)
        mine &= (np.uint64(1) << possible) - np.uint64(1)  # 64 wraps to all bits
        order = np.lexsort((mine, own))
        rest, own, mine = rest[order], own[order], mine[order]
        starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (mine[1:] != mine[:-1])]))
        ends = np.append(starts[1:], len(rest))
        values, get = [], known.get
        for k, skips in zip(own[starts].tolist(), mine[starts].tolist(), strict=True):
            c, (bits, ids) = names[k], runs[k]
            if bits >= 0:
                left, skipped = skips & bits, 0
                while left:
                    skipped |= left & -left
                    if (run := get((c, skipped))) is None:
                        break
                    bits, ids = run
                    left = skips & bits & ~skipped
                if not left:
                    values.append(ids)
                    continue
            new.append((len(values), c, skips))
            values.append(b"")
        found = self.vocabulary.run_many([c for _, c, _ in new], np.array([skips for _, _, skips in new], np.uint64))
        alone = []
        for (at, c, skips), (ids, turns) in zip(new, found, strict=True):
            if turns <= TURNS and ids is not None:
                bits = (1 << turns) - 1
                if turns <= KEPT:
                    known[(c, skips & bits) if skips & bits else c] = bits, ids
            elif self.dropout:  # more turns than coins drawn ahead: each place by itself
                alone.append((at, c))
                continue
            values[at] = ids
        each = np.empty(len(values), object)
        each[:] = values
        out[rest] = np.repeat(each, ends - starts)
        for at, c in alone:
            for k in rest[starts[at] : ends[at]].tolist():
                out[k] = np.array(self.vocabulary.segment(c, self.dropout, int(salts[k])), np.int32).tobytes()
        return out.tolist()

    def many(self, texts: list[str], doc_ids: list) -> list[np.ndarray]:
        """Ids of each text."""
        own = [_CHUNK.findall(" " + text) if text else [] for text in texts]
        gc.disable()  # the cache has no cycles, and is long to walk
        flat = [c for chunks in own for c in chunks]
        salts = [self.salts(d, len(chunks)) for d, chunks in zip(doc_ids, own, strict=True)]
        salts = np.concatenate(salts) if salts else np.empty(0, np.uint64)
        pieces = []
        for at in range(0, len(flat), BLOCK):
            if len(self.known) > self.room:
                self.known.clear()
            pieces += self._ids(flat[at : at + BLOCK], salts[at : at + BLOCK])
        gc.enable()
        ends = np.cumsum([len(chunks) for chunks in own]).tolist()
        return [np.frombuffer(b"".join(pieces[e - len(chunks) : e]), np.int32) for e, chunks in zip(ends, own, strict=True)]


_ENCODERS: dict = {}  # one per worker and setting: its cache serves all of the worker's tasks


def _encoder(vocabulary: Vocabulary, *setting) -> Encoder:
    if setting not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[setting] = Encoder(vocabulary, *setting)
    return _ENCODERS[setting]


def _slices(batch: pa.RecordBatch, at: int, limit: int = 4 << 20):
    """Parts of a batch with about ``limit`` bytes of text."""
    sizes = pc.binary_length(batch.column(at).fill_null("")).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def encode(
    docs: DataFrame, model_path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED,
    id_column: str = "doc_id", text_column: str = "text", drop_text: bool = True,
) -> DataFrame:
    """Adds n_pieces, piece_ids, ids_sha256 and lossless (whether decoding gives the text back)."""
    vocabulary = Vocabulary(model_path)
    setting = (dropout, seed)
    kept = [c for c in docs.columns if not (drop_text and c == text_column)]
    own = StructType(
        [
            StructField("n_pieces", LongType()), StructField("piece_ids", ArrayType(IntegerType())),
            StructField("ids_sha256", StringType()), StructField("lossless", BooleanType()),
        ]
    )
    clash = {c.lower() for c in kept} & {f.name for f in own}
    if clash:
        raise ValueError(f"documents already have columns {sorted(clash)}")
    at, ident = docs.columns.index(text_column), docs.columns.index(id_column)
    through = [docs.columns.index(c) for c in kept]

    def run(batches):
        encoder = _encoder(vocabulary, *setting)
        for whole in batches:
            for batch in _slices(whole, at):
                texts = batch.column(at).fill_null("").to_pylist()
                ids = encoder.many(texts, batch.column(ident).to_pylist())
                hashes = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
                same = vocabulary.same(ids, texts)
                lengths = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                pieces = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in through), pa.array(lengths), pieces, pa.array(hashes, pa.string()), pa.array(same, pa.bool_())],
                    [*kept, *own.names],
                )

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in kept), *own.fields]))


def decode(encoded: DataFrame, model_path: str = MODEL, ids_column: str = "piece_ids", out: str = "text") -> DataFrame:
    """Adds the decoded text; NULL ids give NULL."""
    vocabulary = Vocabulary(model_path)
    at, names = encoded.columns.index(ids_column), [*encoded.columns, out]

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(ids).decode() for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out, StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as pieces (the last stage)."""
    return encode(docs.select("doc_id", "lang", "source", "text"))

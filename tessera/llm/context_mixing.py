"""Language-model scoring by online logistic context mixing.

A text is its lower-cased tokens, a blank after each, and a line end. Each byte is predicted bit by bit along a Huffman code of the training bytes. Predictors
are keyed by hashed contexts, the last 3 and 5 bytes and the word so far: from the counts of the bytes that followed a context in training texts, each node
of the code gets the log odds of its bit. A bit's log odds are the dot product of the predictors' with a weight vector chosen by a gate (depth in the code, and how
often the word so far was met), refined by gradient steps within each document after every ``BLOCK`` bytes. So each token gets a probability from its bits. A second
gate mixes it with the token's unigram probability, whose counts know every token of the corpus however large it grows: its log odds are the sum of the differences of
the two, token by token, over the document so far. A text's score depends on the text and the counts alone, and total bits are over all events.

Start weights of the first gate are fitted on one in ``FIT_SHARE`` of the training texts (by hash, whole, of any length), which the context counts leave out:
each task takes gradient steps over its share, and the tasks' weights are averaged by events.

The base score is an add-0.1 unigram model of the tokens, from all training rows. Counts of tokens that
make up more than one in ``FREQUENT`` of all (so at most that many tokens) are sent to every task; those of the rest are joined.
The context counts have a fixed number of cells; tables are made of them in tasks.

Defined cases: null counts as empty; an empty text has one token, its end; a null doc_id counts as training; repeated rows count as often as they occur, and each gets a
row. Without training rows N and V are 0: base_score is the log of an even choice among one token, all bits are even. Other columns are ignored.
An empty table gives no rows. A very long text is scored whole, by itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle as pickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NONSPACE, U64, Words, discard, documents, mix, pieces, powers, utf8, written

#: Context lengths (0: the word so far), and the bits of their hashed slots.
ORDERS = ((3, 14), (5, 16), (0, 17))
FREQUENT = 4_000_000
FIT_SHARE = 32
#: Gates: depths of the code, times levels of how often the last context was met (fourfold steps).
DEPTHS, SURE = 6, 8
GATES, LIMIT, STEPS = DEPTHS * SURE, 8.0, 16
#: Bytes of a document between two updates of its weights; step size of an update.
BLOCK, RATE, FIT_RATE = 64, 0.008, 0.02
CHUNK = 1 << 18
#: Bytes of text that are cut into tokens or counted at once, and that are scored at once; rows of about one length that are scored side by side. They change no score.
PART, SCORED, ROWS = 1 << 17, 1 << 22, 64
#: Tokens that are put in order at once.
FRESH = 1 << 18
#: Steps of a unit of log odds in the tables of the logistic, and how many there are on each side.
FINE, EDGE = 256, 4095
END = np.uint64(0x0E4D)
_BYTE32 = (mix(np.arange(1, 257, dtype=np.uint64)) >> U64(32)).astype(np.uint32)
_POWER32 = (powers(256) & U64(0xFFFFFFFF)).astype(np.uint32)
#: Log odds of the second gate at a text's start (for the unigram), and at most; how many bits of difference move it by one; a single token's at most.
MIX_START, MIX_LIMIT, MIX_STEP, MIX_CLIP = 1.0, 4.0, 12.0, 6.0
_ODDS = np.arange(-EDGE, EDGE + 1) / FINE
#: The loss of log odds against the bit that came, in nats, and the chance that the other was given.
_LOSS, _MISS = np.logaddexp(0, _ODDS).astype(np.float32), (1 / (1 + np.exp(-_ODDS))).astype(np.float32)
#: Both by rounded log odds, those of bit 0 and then those of bit 1.
_SIDES = 2 * EDGE + 1
_LOSSES, _MISSES = np.concatenate([_LOSS, _LOSS[::-1]]), np.concatenate([_MISS, -_MISS[::-1]])
WHOLE = "uid long, doc_id long, n_tokens long, n_known long, common double, bits double, n_bytes long, rare array<struct<token:long,bits:float,odds:float>>"


def stream(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens, a blank after each and an end after the last, end to end, and the bounds of the rows."""
    n = np.diff(w.first)
    length = w.end - w.start
    size = np.concatenate([[0], np.cumsum(length + 1)])
    bounds = size[w.first] + np.arange(len(n) + 1)
    out = np.full(int(bounds[-1]), 32, np.uint8)
    word = np.ones(len(out), bool)
    word[size[:-1] + np.repeat(np.arange(len(n)), n) + length] = word[bounds[1:] - 1] = False
    out[word] = w.text[w.inside]
    out[bounds[1:] - 1] = 10
    return out, bounds


def contexts(text: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Slot of each byte's context, for each order; ends stand before a text's start."""
    h = np.zeros(len(text), np.uint32)
    # The first bytes of each row, by how far they are from its start.
    heads = [bounds[:-1][np.diff(bounds) > j] + j for j in range(max(j for j, _ in ORDERS))]
    out: list[np.ndarray] = []
    want = dict(ORDERS)
    for j in range(1, max(want) + 1):
        before = np.empty_like(text)
        before[:j] = 10
        before[j:] = text[:-j] if len(text) > j else text[:0]
        for at in heads[:j]:
            before[at] = 10
        h = (h + before + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if j in want:
            out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - want[j])).astype(np.int32))
    # The word so far: sums of hashed bytes from the word's start, each times a power of its place.
    at = np.flatnonzero(start_of_word(text, bounds))
    length = np.diff(np.append(at, len(text)))
    since = np.arange(len(text), dtype=np.uint32)
    since -= np.repeat(at.astype(np.uint32), length)
    terms = _BYTE32.take(text)
    terms *= _POWER32.take(since, mode="clip")
    total = np.cumsum(terms, dtype=np.uint32)
    total -= terms
    word = (total - np.repeat(total[at], length)) * np.uint32(2) + np.uint32(1)
    word = (word ^ (word >> np.uint32(16))) * np.uint32(0x9E3779B1) + since
    out.append(((word * np.uint32(0x85EBCA6B)) >> np.uint32(32 - want[0])).astype(np.int32))
    return out


def tokens(w: Words) -> np.ndarray:
    return w.hashes()


def tokenised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stream of some texts and the bounds of its rows; of each token, ends too, the hash and the bytes; the bounds of the rows' tokens."""
    made = []
    for a, b in pieces(offsets, PART):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NONSPACE)
        text, bounds = stream(w)
        first = w.first + np.arange(b - a + 1)
        h = np.full(int(first[-1]), END)
        word = np.ones(len(h), bool)
        word[first[1:] - 1] = False
        h[word] = tokens(w)
        size = np.ones(len(h), np.int64)
        size[word] = w.end - w.start + 1
        made.append((text, np.diff(bounds), h, size, np.diff(first)))
    text, n, h, size, many = (np.concatenate(x) for x in zip(*made, strict=True))
    return text, np.concatenate([[0], np.cumsum(n)]), h, size, np.concatenate([[0], np.cumsum(many)])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def fits() -> Column:
    """Training rows that fit the gates."""
    return F.xxhash64("text") % FIT_SHARE == 0


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's tokens (kind 0) and context cells (the order's number from 1), these without the rows that fit the gates."""
    sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in range(len(ORDERS) + 1)}
    cells = [np.zeros(256 << bits, np.int32) for _, bits in ORDERS]
    fresh: list[np.ndarray] = []
    ends = held = 0

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x in range(0, len(key), 100_000):
            k = key[x : x + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64) if k.dtype == np.uint64 else k), pa.array(n[x : x + 100_000].astype(np.int64))], ["kind", "key", "n"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([k for k, _ in sums[0]])
        n = np.concatenate([c for _, c in sums[0]])
        value, back = np.unique(key, return_inverse=True)
        return value, np.bincount(back, n, len(value)).astype(np.int64)

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ends += len(batch)
        for a, b in pieces(offsets, PART):
            w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NONSPACE)
            fresh.append(tokens(w))
            if sum(map(len, fresh)) > FRESH:
                sums[0].append(np.unique(np.concatenate(fresh), return_counts=True))
                held += len(sums[0][-1][0])
                fresh = []
            text, bounds = stream(w)
            kept = ~batch.column("fits").to_numpy(zero_copy_only=False)[a:b]
            if not kept.all():
                size = np.diff(bounds)
                text, bounds = text[np.repeat(kept, size)], np.concatenate([[0], np.cumsum(size[kept])])
            for k, slot in enumerate(contexts(text, bounds)):
                cell = slot.astype(np.int64)
                cell <<= 8
                cell |= text
                np.add.at(cells[k], cell, np.int32(1))
            if held > 3_000_000:
                sums[0] = [merged()]
                if len(sums[0][0][0]) > 1_500_000:
                    yield from rows(0, *sums[0][0])
                    sums[0] = []
                held = sum(len(k) for k, _ in sums[0])
    if fresh:
        sums[0].append(np.unique(np.concatenate(fresh), return_counts=True))
    if sums[0]:
        yield from rows(0, *merged())
    if ends:
        yield from rows(0, np.array([END]), np.array([ends]))
        for k, c in enumerate(cells):
            at = np.flatnonzero(c)
            yield from rows(k + 1, at, c[at])


class Code:
    """Huffman code of bytes: for each byte, the nodes on its path and the bits taken there."""

    def __init__(self, weight: np.ndarray):
        heap = [(float(weight[b]) + 1e-3, b, b) for b in range(256)]
        heapq.heapify(heap)
        kids: list[tuple[int, int]] = []
        while len(heap) > 1:
            x, y = heapq.heappop(heap), heapq.heappop(heap)
            kids.append((x[2], y[2]))
            heapq.heappush(heap, (x[0] + y[0], min(x[1], y[1]), 255 + len(kids)))
        self.kids = kids
        path: dict[int, list[tuple[int, int]]] = {255 + len(kids): []}
        for k in range(len(kids) - 1, -1, -1):
            for bit in (0, 1):
                path[kids[k][bit]] = [*path[256 + k], (k, bit)]
        self.length = np.array([len(path[b]) for b in range(256)])
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.node = np.array([n for b in range(256) for n, _ in path[b]], np.int32)
        self.bit = np.array([t for b in range(256) for _, t in path[b]], bool)
        self.depth = np.array([d for b in range(256) for d in range(len(path[b]))], np.int32)

    def node_counts(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of (slots, 256) byte counts: how often each node's bit was 0 and 1."""
        total = np.zeros((len(cells), 511), np.float32)
        total[:, :256] = cells
        for k, (x, y) in enumerate(self.kids):
            total[:, 256 + k] = total[:, x] + total[:, y]
        left, right = np.array(self.kids).T
        return total[:, left], total[:, right]


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log(n1 + np.float32(0.05)) - np.log(n0 + np.float32(0.05))


class Events:
    """The coded bits of some bytes, in their order: predictor cells, gates, bits."""

    def __init__(self, code: Code, text: np.ndarray, slots: list[np.ndarray], sure: np.ndarray):
        n = code.length[text]
        ends = np.cumsum(n)
        self.times = n
        self.bounds = np.concatenate([[0], ends])
        at = np.repeat(code.start[text] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        node = code.node[at]
        self.bit = code.bit[at]
        self.gate = np.minimum(code.depth[at], DEPTHS - 1) * SURE + np.repeat(sure[slots[-1]], n)
        self.cells = [np.repeat(s.astype(np.int32) << 8, n) + node for s in slots]


class Model:
    """Code, tables of log odds (one int8 for each slot and node) and start weights."""

    def __init__(self, code: Code, tables: list[np.ndarray], met: np.ndarray):
        self.code = code
        self.tables = [t.reshape(-1) for t in tables]
        self.sure = np.minimum(np.log2(met + 1) / 2, SURE - 1).astype(np.int32)
        self.weights = np.full((GATES, len(ORDERS)), 0.35, np.float32)

    def fit(self, text: np.ndarray, bounds: np.ndarray) -> int:
        """Gradient steps over some texts; how many bits they had."""
        e = Events(self.code, text, contexts(text, bounds), self.sure)
        x = [np.take(t, c).astype(np.float32) / STEPS for t, c in zip(self.tables, e.cells, strict=True)]
        gate = e.gate.astype(np.int64)
        weights = [self.weights[:, k].copy() for k in range(len(ORDERS))]
        for i in range(0, len(gate), 512):
            own, inputs = gate[i : i + 512], [v[i : i + 512] for v in x]
            z = weights[0].take(own) * inputs[0]
            for w, v in zip(weights[1:], inputs[1:], strict=True):
                z += w.take(own) * v
            np.clip(z, -30, 30, out=z)
            err = e.bit[i : i + 512] - 1 / (1 + np.exp(-z))
            for w, v in zip(weights, inputs, strict=True):
                w += FIT_RATE * np.bincount(own, err * v, GATES).astype(np.float32) / 8
        self.weights = np.stack(weights, 1)
        return len(gate)

    def bits(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each byte. Rows of about one length go side by side, so that few steps have few rows."""
        size = np.diff(bounds)
        out = np.empty(len(text))
        order = np.argsort(-size, kind="stable")
        for g in range(0, len(order), ROWS):
            own = order[g : g + ROWS]
            ends = np.cumsum(size[own])
            at = np.repeat(bounds[:-1][own] - (ends - size[own]), size[own]) + np.arange(int(ends[-1]))
            out[at] = self._nats(text[at], np.concatenate([[0], ends]))
        out /= np.log(2)
        return out

    def _nats(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Nats of each byte of some rows, the longest first. A step takes the next ``BLOCK`` bytes of every row that has some left, so what is kept for each bit is as long as a step."""
        code, size = self.code, np.diff(bounds)
        block = (np.arange(len(text)) - np.repeat(bounds[:-1], size)) // BLOCK
        steps = np.concatenate([[0], np.cumsum(np.bincount(block))])
        order = np.argsort(block.astype(np.uint16) if len(steps) <= 1 << 16 else block, kind="stable")
        slots = contexts(text, bounds)
        gate = (np.repeat(np.arange(len(size)) * GATES, size) + self.sure[slots[-1]])[order]
        slots = [s[order].astype(np.int64) << 8 for s in slots]
        text = text[order]
        times = code.length[text]
        edge = np.concatenate([[0], np.cumsum(times)])
        path = code.start[text] - edge[:-1]
        live = np.searchsorted(-size, -BLOCK * np.arange(len(steps) - 1)) * GATES
        # Of each bit of a path, in one word: node, gate of its depth, side.
        way = code.node.astype(np.int64) | np.minimum(code.depth, DEPTHS - 1).astype(np.int64) * SURE << 8 | (np.where(code.bit, _SIDES, 0) + EDGE) << 16
        # Weights give log odds in steps of 1 / FINE from the tables' own steps; both are powers of two.
        weights = [np.tile(self.weights[:, k] * np.float32(FINE / STEPS), len(size)) for k in range(len(ORDERS))]
        out = np.empty(int(edge[-1]), np.float32)
        for a, b, first, last, most in zip(steps.tolist(), steps[1:].tolist(), edge[steps[:-1]].tolist(), edge[steps[1:]].tolist(), live.tolist(), strict=False):
            n = times[a:b]
            bit = np.repeat(path[a:b], n)
            bit += np.arange(first, last)
            turn = way.take(bit, mode="clip")
            below = turn & 255
            side = turn >> 16
            turn >>= 8
            turn &= 255
            slot = np.repeat(gate[a:b], n)
            slot += turn
            inputs: list[np.ndarray] = []
            for k in range(len(ORDERS)):
                cell = np.repeat(slots[k][a:b], n)
                cell += below
                inputs.append(self.tables[k].take(cell, mode="clip").astype(np.float32))
                part = weights[k].take(slot, mode="clip")
                part *= inputs[k]
                z = np.add(z, part, out=z) if k else part
            np.rint(z, out=z)
            np.maximum(z, -EDGE, out=z)
            np.minimum(z, EDGE, out=z)
            at = z.astype(np.int64)
            at += side
            out[first:last] = _LOSSES.take(at, mode="clip")
            miss = _MISSES.take(at, mode="clip")
            for k, x in enumerate(inputs):
                x *= miss
                weights[k][:most] -= RATE * np.bincount(slot, x, most).astype(np.float32)
        back = np.empty(len(text))
        back[order] = np.add.reduceat(out, edge[:-1])
        return back


def start_of_word(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(text), bool)
    out[1:] = text[:-1] == 32
    out[bounds[:-1]] = True
    return out


def log2_mean(odds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log2 of the mean of 2 ** a and 2 ** b, the first weighted by the logistic of ``odds``."""
    first, second = a - np.logaddexp(0, -odds) / np.log(2), b - np.logaddexp(0, odds) / np.log(2)
    return np.logaddexp2(first, second)


def running(d: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the sum of d over the tokens of its row before it."""
    total = np.concatenate([[0.0], np.cumsum(d)])[:-1]
    n = np.diff(first)
    return total - np.repeat(total[first[:-1]] if len(d) else total[:0], n)


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all training rows."""
    rows = docs.where(~held_out()).select("text", F.coalesce(fits(), F.lit(False)).alias("fits")).mapInArrow(count, "kind byte, key long, n long")
    # A task has a key once or twice, so summing before the shuffle would only cost.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, counted: DataFrame) -> Model:
    """The mixing model. Tasks make a row of each slot's log odds; the driver gets those rows, a fixed number, and the tasks' weights."""
    spark = docs.sparkSession
    cells = counted.where("kind > 0").select((F.col("kind") - 1).cast("int").alias("k"), F.shiftright("key", 8).alias("slot"), F.col("key").bitwiseAND(255).cast("int").alias("byte"), "n")
    weight = np.zeros(256)
    for r in cells.where("k = 0").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        weight[r.byte] = r.n
    code = Code(weight)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            which = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            n = np.zeros((len(batch), 256), np.float32)
            n[which, flat.field("byte").to_numpy()] = flat.field("n").to_numpy()
            for i in range(0, len(n), 1024):
                part = n[i : i + 1024]
                table = np.zeros((len(part), 256), np.int8)
                table[:, :255] = np.clip(np.rint(log_odds(*code.node_counts(part)) * STEPS), -127, 127)
                own = slice(i, i + len(part))
                yield pa.RecordBatch.from_arrays([batch.column("k")[own], batch.column("slot")[own], pa.array(part.sum(1).astype(np.int64)), pa.array([t.tobytes() for t in table], pa.binary())], ["k", "slot", "met", "odds"])

    grouped = cells.groupBy("k", "slot").agg(F.collect_list(F.struct("byte", "n")).alias("cells"))  # at most 256 cells a slot
    made = written(spark, grouped.mapInArrow(rows, "k int, slot long, met long, odds binary"))
    # A slot that was never met is even.
    tables = [np.zeros((1 << bits, 256), np.int8) for _, bits in ORDERS]
    met = np.zeros(1 << ORDERS[-1][1])
    for k in range(len(ORDERS)):
        got = made.where(F.col("k") == k).select("slot", "met", "odds").toArrow()
        if got.num_rows:
            slot = got["slot"].to_numpy()
            tables[k][slot] = np.frombuffer(b"".join(got["odds"].to_pylist()), np.int8).reshape(-1, 256)
            if k + 1 == len(ORDERS):
                met[slot] = got["met"].to_numpy()
    discard(made)
    model = Model(code, tables, met)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = None
        bits = 0
        for batch in batches:
            own = own or pickle.loads(shared.value)
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets, CHUNK):
                bits += own.fit(*stream(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NONSPACE)))
        if bits:
            yield pa.RecordBatch.from_arrays([pa.array([bits]), pa.array([own.weights.reshape(-1).tolist()], pa.list_(pa.float64()))], ["bits", "weights"])

    learned = docs.where(~held_out() & fits()).select("text").mapInArrow(fit, "bits long, weights array<double>")
    learned = learned.select("bits", F.posexplode("weights").alias("i", "w")).groupBy("i").agg((F.sum(F.col("w") * F.col("bits")) / F.sum("bits")).alias("w")).collect()
    if learned:
        model.weights = np.array([r.w for r in sorted(learned, key=lambda r: r.i)], np.float32).reshape(GATES, len(ORDERS))
    return model


def scored(docs: DataFrame, model: Model, counted: DataFrame, total: int, kinds: int) -> DataFrame:
    """One row for each document: its mixed bits over frequent tokens, the base sum over them, and its other tokens, each with the bits of its bytes and the second gate's log odds."""
    spark = docs.sparkSession
    often = counted.where((F.col("kind") == 0) & (F.col("n") * FREQUENT > total)).select("key", "n").toArrow()
    key = often["key"].to_numpy().view(np.uint64)
    turn = np.argsort(key)
    shared = spark.sparkContext.broadcast(pickle.dumps((model, key[turn], often["n"].to_numpy()[turn])))
    whole = np.log2(total + 0.1 * (kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, n_of = pickle.loads(shared.value)
        value = np.log2(n_of + 0.1) if len(known) else np.zeros(1)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets, SCORED):
                rows = b - a
                text, bounds, h, size, first = tokenised(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                by_bytes = -np.add.reduceat(own.bits(text, bounds), np.cumsum(size) - size) if len(h) else np.zeros(0)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                else:
                    at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
                by_counts = value[at] - whole
                odds = np.clip(running(np.where(hit, np.clip(by_counts - by_bytes, -MIX_CLIP, MIX_CLIP), 0.0), first) / MIX_STEP + MIX_START, -MIX_LIMIT, MIX_LIMIT)
                row = np.repeat(np.arange(rows), np.diff(first))
                bits = np.bincount(row[hit], -log2_mean(odds[hit], by_counts[hit], by_bytes[hit]), rows)
                few = np.flatnonzero(~hit)
                items = pa.StructArray.from_arrays([pa.array(h[few].view(np.int64)), pa.array(by_bytes[few].astype(np.float32)), pa.array(odds[few].astype(np.float32))], ["token", "bits", "odds"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("uid").slice(a, rows),
                        batch.column("doc_id").slice(a, rows),
                        pa.array(np.diff(first)),
                        pa.array(np.bincount(row[hit], minlength=rows)),
                        pa.array(np.bincount(row[hit], value[at[hit]], rows).astype(float)),
                        pa.array(bits.astype(float)),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(row[few], np.arange(rows + 1)), pa.int32()), items),
                    ],
                    ["uid", "doc_id", "n_tokens", "n_known", "common", "bits", "n_bytes", "rare"],
                )

    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(run, WHOLE)


def report(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = written(spark, counts(docs))
    n, v = counted.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = written(spark, scored(docs, train(docs, counted), counted, n, v))
    rare = rows.select("uid", F.explode("rare").alias("x")).select("uid", F.col("x.token").alias("key"), "x.bits", "x.odds")
    few = counted.where((F.col("kind") == 0) & (F.col("n") * FREQUENT <= n)).select("key", "n")
    log2 = lambda x: F.log2(x)
    count_bits = log2(F.coalesce("n", F.lit(0)) + 0.1) - log2(F.lit(n + 0.1 * (v + 1)))
    gate = 1 / (1 + F.exp(-F.col("odds")))
    # Weighed from the larger of the two, so that neither vanishes.
    most = F.greatest(F.col("own"), F.col("bits"))
    mixed = most + log2(gate * F.pow(F.lit(2.0), F.col("own") - most) + (1 - gate) * F.pow(F.lit(2.0), F.col("bits") - most))
    rare = rare.join(few, "key", "left").withColumn("own", count_bits).groupBy("uid").agg(
        F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("less"), F.sum(-mixed).alias("rare_bits")
    )
    rows = rows.drop("rare").join(rare, "uid", "left")
    bits = F.col("bits") + F.coalesce("rare_bits", F.lit(0.0))
    base = F.col("common") * F.lit(float(np.log10(2))) + F.coalesce("less", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(n + 0.1 * (v + 1)))
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (-bits * F.lit(float(np.log10(2)))).alias("score"),
        (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))

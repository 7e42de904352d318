"""Removal of repeated passages by merging Burrows-Wheeler transforms.

A start is repeated if the ``WINDOW`` bytes from it also start elsewhere. Each window is filed under its anchor, the
``ANCHOR``-byte string of least hash in it (the first of equals), so equal windows meet under one anchor wherever they stand. Successive
windows with the same anchor place form a context; equal contexts are counted before any shuffle and again after it (those of common anchors in parts), and anchors met
once are done. Of the others one copy of each context is fetched and dealt out by anchor.

There, contexts are strings over an alphabet of ``STEP``-byte symbols, one string for each phase, so ``WINDOW // STEP`` symbols are a
window. Two shards of them are sorted by themselves, giving their transforms; then the interleave of the two is refined:
round k finds, from the bounds of each suffix in the other shard's order after k symbols, those of its predecessor after
k + 1, by ranks of the predecessor's symbol. After all rounds the bounds enclose the suffixes whose common prefix is a whole window or more:
a repeated interval. No suffix of the merged set is sorted again. An anchor with more than ``HOT`` different contexts is cut
into single windows, which are counted by a 128-bit digest over all tasks, so no task gets an unbounded group.

Defined cases: null counts as empty; texts shorter than a window lose nothing; repeated rows are copies of each other, so they lose all that lies in windows, and are
handled as one row that counts as often as it comes; a null doc_id is kept as null. A very long text is one row of one task, which takes about 80 bytes of memory for each of its bytes. Ties, as of
windows with several places of least hash, go to the first place and change nothing in the result. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import U64, documents, mix, pieces, powers, utf8, window_min, written

WINDOW, STEP, ANCHOR = 200, 8, 32
HOT = 8192
#: Bytes of contexts merged at once, and of text handled at once: what is made of them fits the cache. Rows of a batch of contexts.
BLOCK, CHUNK, BATCH = 1 << 17, 1 << 17, 10_000
FILTER_BITS = 25
#: Documents looked at for common anchors, how many of these there may be, and in how many parts the contexts of one are counted.
SAMPLE, MOST_COMMON, SALTS = 4000, 5000, 64
COUNTED = "akey long, chash long, n long, dkey long, lo long, hi long"
_PLACE = 31
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def contexts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All contexts of some texts: row, first and last window start within the row, anchor and digest."""
    n = len(data)
    names = ("row", "lo", "hi", "akey", "chash")
    if n < WINDOW:
        return {k: np.zeros(0, np.int64) for k in names}
    words = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    h = np.zeros(n - ANCHOR + 1, np.uint64)
    for k in range(0, ANCHOR, 8):
        h = mix(h + words[k : k + len(h)] * U64(0x9E3779B97F4A7C15) + U64(k))
    order = (h >> U64(_PLACE)) << U64(_PLACE) | np.arange(len(h), dtype=np.uint64)
    low = np.concatenate([window_min(order[a : a + (1 << 16) + WINDOW - ANCHOR], WINDOW - ANCHOR + 1) for a in range(0, n - WINDOW + 1, 1 << 16)])[: n - WINDOW + 1]
    place = (low & U64((1 << _PLACE) - 1)).astype(np.int64)
    size = np.diff(offsets)
    start = np.repeat(offsets[:-1], np.maximum(size - WINDOW + 1, 0))
    count = np.maximum(size - WINDOW + 1, 0)
    i = start + np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    place = place[i]
    new = np.ones(len(i), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    lo, hi, at, begin = i[first], i[last], place[first], start[first]
    pw = powers(n + 1)
    back = powers(n + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    table = mix(np.arange(1, 257, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * pw[:n], dtype=np.uint64)])
    code = mix((total[hi + WINDOW] - total[lo]) * back[lo] + mix((hi - lo).astype(np.uint64)))
    row = np.searchsorted(offsets, begin, "right") - 1
    return {"row": row, "lo": lo - begin, "hi": hi - begin, "akey": h[at].view(np.int64), "chash": code.view(np.int64)}


def batched(parts: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns in parts, as batches of about ``BATCH`` rows."""
    held: list[list[np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(p[0]) for p in held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of each block of text, equal ones as one row with their number; a document counts as often as it has copies."""

    def counted() -> Iterator[list[np.ndarray]]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            dkey, copies = batch.column("dkey").to_numpy(), batch.column("copies").to_numpy()
            for a, b in pieces(offsets, CHUNK):
                c = contexts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(c["row"]):
                    continue
                order = np.lexsort((c["chash"], c["akey"]))
                k, m = c["akey"][order], c["chash"][order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
                first = np.flatnonzero(new)
                one = order[first]
                yield [k[first], m[first], np.add.reduceat(copies[a + c["row"][order]], first), dkey[a + c["row"][one]], c["lo"][one], c["hi"][one]]

    yield from batched(counted(), ["akey", "chash", "n", "dkey", "lo", "hi"])


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        lists = batch.column("want")
        flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        row = np.repeat(np.arange(len(batch)), np.diff(ends))
        lo, hi = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("lo", "hi"))
        a, b = offsets[row] + lo, offsets[row] + hi + WINDOW
        for x in range(0, len(row), 20_000):
            own = slice(x, x + 20_000)
            cut = [data[s:e].tobytes() for s, e in zip(a[own].tolist(), b[own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(flat.field(f).slice(x, 20_000) for f in ("akey", "chash", "n", "hot")), pa.array(cut, pa.binary())], ["akey", "chash", "n", "hot", "text"])


#: Bits of a place or a rank where three of them share a word.
_PACKED = 21


def ranked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks from 1 of pairs of ranks, equal pairs alike. One vectorised sort of words that hold both and the place, where they fit."""
    n = len(high)
    if n >= 1 << _PACKED:
        return np.unique(high.astype(np.uint64) << U64(32) | low.astype(np.uint64), return_inverse=True)[1].astype(np.int64) + 1
    word = np.sort(high.astype(np.uint64) << U64(2 * _PACKED) | low.astype(np.uint64) << U64(_PACKED) | np.arange(n, dtype=np.uint64))
    pair, at = word >> U64(_PACKED), (word & U64((1 << _PACKED) - 1)).astype(np.int64)
    out = np.empty(n, np.int64)
    out[at] = np.cumsum(np.concatenate([[True], pair[1:] != pair[:-1]])) if n else pair
    return out


def placed(value: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Places in the order of value (and second), equal ones by place."""
    n = len(value)
    if n >= 1 << _PACKED:
        return np.lexsort((second, value)) if second is not None else np.argsort(value, kind="stable")
    word = value.astype(np.uint64) << U64(2 * _PACKED) | np.arange(n, dtype=np.uint64)
    if second is not None:
        word |= second.astype(np.uint64) << U64(_PACKED)
    word.sort()
    return (word & U64((1 << _PACKED) - 1)).astype(np.int64)


def letters(symbols: np.ndarray) -> np.ndarray:
    """Ranks from 1 of 64-bit symbols in the order of a hash, which is as good an alphabet as any; where two symbols share a hash, in their own order."""
    n = len(symbols)
    if n < 1 << _PACKED:
        word = mix(symbols * U64(0x9E3779B97F4A7C15) + U64(1)) >> U64(_PACKED) << U64(_PACKED) | np.arange(n, dtype=np.uint64)
        word.sort()
        at = (word & U64((1 << _PACKED) - 1)).astype(np.int64)
        value, key = symbols[at], word >> U64(_PACKED)
        new = value[1:] != value[:-1]
        if not (new & (key[1:] == key[:-1])).any():
            out = np.empty(n, np.int64)
            out[at] = np.cumsum(np.concatenate([[True], new])) if n else key
            return out
    return np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1


class Shard:
    """Sorted suffixes of some strings, to a window's depth: their transform."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, weight: np.ndarray):
        self.offsets = offsets
        size = np.diff(offsets)
        total = len(data)
        self.owner = np.repeat(np.arange(len(size)), size)
        self.rest = np.repeat(offsets[1:], size) - np.arange(total)
        self.weight = weight[self.owner]
        self.symbol = np.ndarray((total,), "<u8", np.concatenate([data, np.zeros(STEP, np.uint8)]), 0, (1,)).copy()
        self.full = self.rest >= STEP

    def sort(self, letter: np.ndarray) -> None:
        """Order of the suffixes of a symbol or more, the groups that share a window, and the transform's links. letter: ranks of the full symbols."""
        full = self.full
        one = np.zeros(len(full), np.int64)
        one[full] = letter
        depth, rank, goal = 1, {1: one}, WINDOW // STEP
        while depth < goal:
            add = max(k for k in rank if k <= min(depth, goal - depth) and not k & (k - 1))
            rank[depth + add] = self._join(rank[depth], rank[add], depth)
            depth += add
        at = np.flatnonzero(full)
        self.order = at[placed(rank[goal][at])]
        self.group = rank[goal][self.order]
        self.whole = self.rest[self.order] >= WINDOW
        self.total = np.concatenate([[0], np.cumsum(self.weight[self.order])])
        row = np.zeros(len(full), np.int64)
        row[self.order] = np.arange(len(self.order))
        first = one[self.order]
        self.first = first.astype(np.uint64) << U64(32)
        follow = np.zeros(len(self.order), np.int64)
        more = self.rest[self.order] >= 2 * STEP
        follow[more] = row[self.order[more] + STEP] + 1
        turn = placed(first, follow)
        #: Of each suffix: its first symbol, and the row of what follows plus one (0 for an end), in order.
        self.keys = (self.first | follow.astype(np.uint64))[turn]
        turn = turn[more[turn]]
        self.symbols, self.source, self.target = self.first[turn], follow[turn] - 1, turn

    def _join(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        shift = depth * STEP
        after = np.zeros(len(a), np.int64)
        ok = np.flatnonzero(self.rest > shift)
        after[ok] = b[ok + shift]
        out = ranked(a, after)
        out[a == 0] = 0
        return out


def bounds_in(a: Shard, b: Shard) -> np.ndarray:
    """For each suffix of a, in order: the weight of b's suffixes that share a window with it."""
    low = np.searchsorted(b.keys, a.first)
    high = np.searchsorted(b.keys, a.first + U64(1 << 32))
    code, src, dst = a.symbols, a.source, a.target
    for _ in range(1, WINDOW // STEP):
        live = high[src] > low[src]
        code, src, dst = code[live], src[live], dst[live]
        lo = np.searchsorted(b.keys, code | (low[src] + 1).astype(np.uint64))
        hi = np.searchsorted(b.keys, code | (high[src] + 1).astype(np.uint64))
        low, high = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        low[dst], high[dst] = lo, hi
    return b.total[high] - b.total[low]


def repeated(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings laid end to end, each counted by its weight: the places (in data) whose window occurs at least twice, as starts and ends of runs."""
    n = len(weight)
    half = max(1, n // 2)
    cut = int(offsets[half])
    shards = [Shard(data[:cut], offsets[: half + 1], weight[:half])] + ([Shard(data[cut:], offsets[half:] - cut, weight[half:])] if n > half else [])
    letter = letters(np.concatenate([s.symbol[s.full] for s in shards]))
    at = 0
    for s in shards:
        own = int(s.full.sum())
        s.sort(letter[at : at + own])
        at += own
    mark = np.zeros(len(data) + 2, np.int8)
    for k, s in enumerate(shards):
        start = np.concatenate([[True], s.group[1:] != s.group[:-1]])
        first = np.flatnonzero(start)
        met = np.diff(np.append(s.total[first], s.total[-1]))[np.cumsum(start) - 1]
        if len(shards) == 2:
            met = met + bounds_in(s, shards[1 - k])
        mark[1 + (cut if k else 0) + s.order[(met > 1) & s.whole]] = 1
    edge = np.flatnonzero(np.diff(mark))  # a string's last places start no window, so no run crosses strings
    return edge[::2], edge[1::2]


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, sorted by anchor, to the runs of repeated places of each."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(table: pa.Table) -> pa.RecordBatch:
        akey, chash = table["akey"].to_numpy(), table["chash"].to_numpy()
        new = np.ones(len(akey), bool)
        new[1:] = (akey[1:] != akey[:-1]) | (chash[1:] != chash[:-1])
        if not new.all():  # copies of a document send their contexts each
            table = table.filter(pa.array(new))
            akey, chash = akey[new], chash[new]
        data, offsets = utf8(table["text"].combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        a, b = repeated(data, offsets, table["n"].to_numpy())
        owner = np.searchsorted(offsets, a, "right") - 1
        flat = np.stack([a - offsets[owner], b - offsets[owner]], 1).reshape(-1).astype(np.int32)
        keep = np.unique(owner)
        ends = 2 * np.append(np.searchsorted(owner, keep), len(owner))
        return pa.RecordBatch.from_arrays([pa.array(akey[keep]), pa.array(chash[keep]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["akey", "chash", "runs"])

    for batch in batches:
        akey = batch.column("akey").to_numpy()
        length = np.diff(utf8(batch.column("text").cast(pa.large_binary()).view(pa.large_string()))[1])
        cuts = np.flatnonzero(np.concatenate([[bool(held) and held[-1].column("akey")[-1].as_py() != akey[0]], akey[1:] != akey[:-1]])) if len(akey) else []
        at = 0
        total = np.concatenate([[0], np.cumsum(length)])
        for c in cuts:
            if size + total[c] - total[at] >= BLOCK:
                if c > at:
                    held.append(batch.slice(at, c - at))
                yield flush(pa.Table.from_batches(held))
                held, size, at = [], 0, int(c)
        if len(akey) > at:
            held.append(batch.slice(at))
            size += int(total[-1] - total[at])
    if held:
        yield flush(pa.Table.from_batches(held))


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for akey, chash, n, text in zip(*(batch.column(c).to_pylist() for c in ("akey", "chash", "n", "text")), strict=True):
            m = len(text) - WINDOW + 1
            code = [hashlib.blake2b(text[i : i + WINDOW], digest_size=16).digest() for i in range(m)]
            yield pa.RecordBatch.from_arrays([pa.array([akey] * m, pa.int64()), pa.array([chash] * m, pa.int64()), pa.array([n] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(code, pa.binary())], ["akey", "chash", "n", "at", "code"])


def common_anchors(docs: DataFrame) -> list[int]:
    """Anchors that about one in 500 documents have, by a sample: their contexts are counted in parts. Which they are changes nothing in the result."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    seen = docs.where(F.rand(7) < share).select("dkey", "copies", "text").mapInArrow(count_contexts, COUNTED)
    found = seen.groupBy("akey").agg(F.count_distinct("dkey").alias("m")).where(F.col("m") >= max(4, SAMPLE // 500)).orderBy(F.desc("m")).limit(MOST_COMMON)
    return [r.akey for r in found.collect()]


def repeated_contexts(docs: DataFrame) -> DataFrame:
    """akey, chash and the runs of repeated starts (from the context's first) of every context that has any."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = common_anchors(docs)
    counted = docs.select("dkey", "copies", "text").mapInArrow(count_contexts, COUNTED)
    counted = counted.withColumn("salt", F.when(F.col("akey").isin(common), F.pmod("chash", F.lit(SALTS)) + 1).otherwise(0) if common else F.lit(0).cast("long"))
    counted = counted.repartition(parts, "akey", "salt").groupBy("akey", "salt", "chash").agg(F.sum("n").alias("n"), F.min(F.struct("dkey", "lo", "hi")).alias("one"))
    w = Window.partitionBy("akey", "salt")
    live = counted.select("akey", "salt", "chash", "n", "one", F.sum("n").over(w).alias("met"), F.count("*").over(w).alias("kinds")).where("met > 1 OR salt > 0")
    live = written(spark, live.select("akey", "salt", "chash", "n", "one.*", "kinds"))
    if common:  # at most MOST_COMMON anchors, whose parts are added up
        whole = live.where("salt > 0").groupBy("akey").agg(F.sum("n").alias("met"), F.count("*").alias("kinds")).where("met > 1").drop("met")
        live = live.where("salt = 0").unionByName(live.where("salt > 0").drop("kinds").join(F.broadcast(whole), "akey"))
    alone = live.where("kinds = 1").select("akey", "chash", F.array(F.lit(0), (F.col("hi") - F.col("lo") + 1).cast("int")).alias("runs"))
    want = live.where("kinds > 1").groupBy("dkey").agg(F.collect_list(F.struct("akey", "chash", "n", "lo", "hi", (F.col("kinds") > HOT).alias("hot"))).alias("want"))
    bytes_of = written(spark, docs.select("dkey", "text").join(want, "dkey").select("text", "want").mapInArrow(fetch, "akey long, chash long, n long, hot boolean, text binary"))
    cold = bytes_of.where("not hot").drop("hot").repartition(parts, "akey").sortWithinPartitions("akey", "chash")
    out = alone.union(cold.mapInArrow(merge, "akey long, chash long, runs array<int>"))
    hot = bytes_of.where("hot").drop("hot").dropDuplicates(["akey", "chash"])
    if hot.limit(1).count():
        cut = written(spark, hot.mapInArrow(single_windows, "akey long, chash long, n long, at int, code binary"))
        many = cut.groupBy("code").agg(F.sum("n").alias("met")).where("met > 1").select("code")
        out = out.union(cut.join(many, "code").groupBy("akey", "chash").agg(F.flatten(F.transform(F.array_sort(F.collect_set("at")), lambda x: F.array(x, x + 1))).alias("runs")))
    return written(spark, out)


def bitmap(found: DataFrame) -> np.ndarray:
    """Bits of the anchors found: FILTER_BITS bits however many there are."""
    slot = F.shiftrightunsigned("akey", 64 - FILTER_BITS)
    words = found.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        lists = batch.column("found")
        many = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        flat = lists.flatten()
        runs = flat.field("runs")
        ends = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        begin = flat.field("lo").to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], np.diff(many))
        place = runs.flatten().to_numpy() + np.repeat(begin, np.diff(ends))
        out: list[list] = [[], [], [], []]
        for a, b in pieces(offsets, CHUNK):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            edge = np.zeros(len(own) + 1, np.int32)
            run = place[ends[many[a]] : ends[many[b]]] - offsets[a]
            np.add.at(edge, run[::2], 1)
            np.add.at(edge, run[1::2] + WINDOW - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0  # no run leaves its row, so rows end at nought
            start = gone.copy()
            start[1:] &= ~gone[:-1]
            first = at[:-1][at[:-1] < at[1:]]
            start[first] = gone[first]
            removed, started = (np.concatenate([[0], np.cumsum(x)])[at] for x in (gone, start))
            kept, left = own[~gone], at - removed
            out[0] += np.diff(at).tolist()
            out[1] += np.diff(removed).tolist()
            out[2] += np.diff(started).tolist()
            out[3] += [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(left.tolist(), left[1:].tolist(), strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans(docs: DataFrame) -> DataFrame:
    """dkey and its contexts with repeated starts: found, an array of (lo, runs)."""
    spark = docs.sparkSession
    found = repeated_contexts(docs)
    bits = spark.sparkContext.broadcast(np.packbits(bitmap(found)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bits.value).view(bool)

        def met() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                dkey = batch.column("dkey").to_numpy()
                for a, b in pieces(offsets, CHUNK):
                    c = contexts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    ok = known[(c["akey"].view(np.uint64) >> U64(64 - FILTER_BITS)).astype(np.int64)]
                    yield [dkey[a + c["row"][ok]], c["akey"][ok], c["chash"][ok], c["lo"][ok]]

        yield from batched(met(), ["dkey", "akey", "chash", "lo"])

    met = docs.select("dkey", "text").mapInArrow(again, "dkey long, akey long, chash long, lo long")
    return met.join(found, ["akey", "chash"]).groupBy("dkey").agg(F.collect_list(F.struct("lo", "runs")).alias("found"))


def keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("dkey", F.xxhash64("doc_id", "text"))


def once(docs: DataFrame) -> DataFrame:
    """Each dkey once, with its number of rows. Only rows that are repeated are brought together."""
    spark = docs.sparkSession
    many = written(spark, docs.groupBy("dkey").agg(F.count("*").alias("copies")).where("copies > 1"))
    if many.isEmpty():
        return docs.select("dkey", "text", F.lit(1).cast("long").alias("copies"))
    alone = docs.select("dkey", "text").join(many, "dkey", "left_anti").withColumn("copies", F.lit(1).cast("long"))
    return alone.unionByName(docs.select("dkey", "text").join(many, "dkey").dropDuplicates(["dkey"]))


def report(docs: DataFrame) -> DataFrame:
    docs = keyed(docs)
    return docs.join(spans(once(docs)), "dkey", "left").select("doc_id", "text", "found").mapInArrow(digest, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))

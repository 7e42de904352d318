"""Document fingerprints from closed syncmers.

A k-mer of UTF-8 bytes is a closed syncmer when the smallest hash among its s-mers stands at its first or last
place. That depends on the k-mer alone, so equal passages choose equal anchors whatever surrounds them. A
fingerprint keeps the ``SKETCH`` anchors of smallest hash (each occurrence of an anchor counts), in the order of the
text; likeness is the bottom-sketch estimate of the anchors' Jaccard overlap, counting only matches that keep their order (positional
matching by a longest increasing run).

Defined cases: null text counts as empty; an empty text has the fingerprint '' (like 1 to another empty one, 0 to the
rest); a text without an anchor is anchored by its k-mer of least hash, one shorter than k bytes by itself. Rows with equal doc_id are ordered
by their text, null first; a null doc_id comes first. A very long text is hashed a block at a time. Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, documents, mix, pieces, utf8, window_min

K, S, SKETCH = 20, 8, 64
#: Bytes hashed at a time, so that temporaries stay in the cache.
BLOCK = 1 << 16
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 32-bit hashes of the closed syncmers of a byte run."""
    n = len(data)
    if n < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    data = np.ascontiguousarray(data)
    starts = []
    for a in range(0, n - K + 1, BLOCK):
        b = min(n, a + BLOCK + K - 1)
        words = np.ndarray((b - a - S + 1,), "<u8", data, a, (1,))
        h = words * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        low = window_min(h, K - S + 1)
        starts.append(a + np.flatnonzero((h[: len(low)] == low) | (h[K - S :] == low)))
    at = np.concatenate(starts)
    return at, kmers(data, at)


def kmers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.ndarray((len(data) - S + 1,), "<u8", data, 0, (1,))
    h = mix(words[at] * U64(0xD6E8FEB86659FD93))
    h = mix(h ^ words[at + 8] * U64(0xA0761D6478BD642F))
    return (mix(h ^ words[at + K - S] * U64(0xE7037ED1A0B428DB)) >> U64(32)).astype(np.uint32)


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The anchors kept for each row, in text order."""
    data = np.ascontiguousarray(data)
    at, h = anchors(data)
    first = np.searchsorted(at, offsets[:-1])
    last = np.maximum(first, np.searchsorted(at, offsets[1:] - K, "right"))
    out = []
    for i in range(len(offsets) - 1):
        own = h[first[i] : last[i]]
        if not len(own):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if b - a >= K:
                own = np.sort(kmers(data, np.arange(a, b - K + 1)))[:1]
            elif b > a:
                own = np.array([int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=4).digest(), "big")], np.uint32)
            out.append(own)
            continue
        out.append(sketch(own))
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """The anchors of least hash, in text order; the second and later occurrences of an anchor have hashes of their own."""
    order = np.argsort(own, kind="stable")
    value = own[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    if not new.all():
        place = np.arange(len(value))
        nth = place - np.maximum.accumulate(np.where(new, place, 0))
        again = nth > 0
        value[again] = (mix(value[again].astype(np.uint64) | (nth[again].astype(np.uint64) << U64(32))) >> U64(32)).astype(np.uint32)
    value, where = np.unique(value, return_index=True)
    return value[:SKETCH][np.argsort(order[where[:SKETCH]], kind="stable")]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1, from two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a == b).all():
        return 1.0
    union = np.unique(np.concatenate([a, b]))[:SKETCH]
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    keep = common <= union[-1]
    if not keep.any():
        return 0.0
    run: list[int] = []
    for x in ib[keep][np.argsort(ia[keep])].tolist():
        k = bisect_left(run, x)
        run[k : k + 1] = [x]
    return len(run) / len(union)


def parse(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def show(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return show(sketches(raw, np.array([0, len(raw)]))[0])


def edit_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each row, and for all rows but the last the edited text: the last quarter taken from the start of the next row."""
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(chars, offsets)
    n = np.diff(first)
    edge = np.append(chars, len(data))
    take = n[:-1] // 4
    cut = edge[first[1:-1] - take]
    stop = edge[first[1:-1] + np.minimum(take, n[1:])]
    parts: list[np.ndarray] = []
    for i in range(len(take)):
        parts += [data[offsets[i] : cut[i]], data[offsets[i + 1] : stop[i]]]
    size = (cut - offsets[:-2]) + (stop - offsets[1:-1])
    return n, (np.concatenate(parts) if parts else data[:0]), np.concatenate([[0], np.cumsum(size)])


def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and doc_id; the last of a bucket is a copy of the next bucket's first and gives no row."""
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        table = table.combine_chunks()
        carry = table.slice(table.num_rows - 1)
        if table.num_rows < 2:
            continue
        bucket, ghost = (table[c].to_numpy() for c in ("bucket", "ghost"))
        data, offsets = utf8(table["text"])
        ids = table["doc_id"].to_pylist()
        for a, b in pieces(offsets[:-1], 4 << 20):
            own, at = data[offsets[a] : offsets[b + 1]], offsets[a : b + 2] - offsets[a]
            n, edited, ends = edit_rows(own, at)
            plain, changed = sketches(own, at), sketches(edited, ends)
            keep = [i for i in range(b - a) if not ghost[a + i] and bucket[a + i] == bucket[a + i + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[a + i] for i in keep], pa.int64()),
                    pa.array(n[keep], pa.int64()),
                    pa.array([hashlib.sha256(edited[ends[i] : ends[i + 1]]).hexdigest() for i in keep], pa.string()),
                    pa.array([show(plain[i]) for i in keep], pa.string()),
                    pa.array([show(changed[i]) for i in keep], pa.string()),
                    pa.array([likeness(plain[i], changed[i]) for i in keep], pa.float64()),
                    pa.array([likeness(plain[i], plain[i + 1]) for i in keep], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def neighbours(docs: DataFrame) -> DataFrame:
    """The documents in ranges of doc_id, each range followed by a copy of the document after it."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("at", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("place", F.col("at").cast("double"))
    n = min(3 * parts, 20_000)
    cuts = sorted(set(keyed.select("place").stat.approxQuantile("place", [i / n for i in range(1, n)], 0.2 / n)))
    keyed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="b").transform(keyed) if cuts else keyed.withColumn("b", F.lit(0.0))
    keyed = keyed.select("doc_id", "text", "at", F.col("b").cast("int").alias("b"))
    # At most n rows, one for each range.
    first = sorted((r["b"], r["low"]) for r in keyed.groupBy("b").agg(F.min("at").alias("low")).collect())
    copies = [(first[(i + 1) % len(first)][1], b, i + 1 == len(first)) for i, (b, _) in enumerate(first)]
    if not copies:
        return keyed.select("doc_id", "text", F.col("b").alias("bucket"), F.lit(False).alias("ghost"))
    extra = spark.createDataFrame(copies, "at long, to int, wrap boolean").groupBy("at").agg(F.collect_list("to").alias("to"))
    keyed = keyed.join(F.broadcast(extra), "at", "left")
    own = F.array(F.struct(F.col("b").alias("bucket"), F.lit(False).alias("ghost")))
    more = F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda x: F.struct(x.alias("bucket"), F.lit(True).alias("ghost")))
    rows = keyed.withColumn("x", F.explode(F.concat(own, more)))
    return rows.select("doc_id", "text", "at", "x.bucket", "x.ghost").repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", "at", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).drop("at")


def fingerprints(docs: DataFrame) -> DataFrame:
    return neighbours(docs).mapInArrow(with_next, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))

"""Hard-negative mining by blocked dense products.

Anchors are dealt into blocks of at most ``BLOCK_VALUES`` components. Each block is broadcast against all candidates, which every task takes in tiles: one matrix
product in float64 a tile, exact while no sum can reach 2^53; beyond that bound the tile is multiplied in whole numbers. The first pass keeps each anchor's
first positives, a list that merges across tiles, tasks and blocks of candidates; the second pass, told the positives' scores, keeps the first negatives
of each positive's window. Lists are merged once more by Spark, over tasks. A block of anchors costs two passes over the candidates, and each pass
multiplies every value it reads by the whole block, so reading is a small part of it.

The anchor itself is among the candidates: one more positive is kept, and one entry of the anchor's own id and score goes, if it is there.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part. A null vec_id is no anchor; as a candidate it comes
after all ids of its score. Repeated rows are rows each: as candidates, and as anchors, whose results are repeated. Of vectors of different lengths what the
shorter has not counts as 0; an empty vector scores 0 with all. Scores stop at the ends of long. Very long vectors make blocks of fewer anchors. An
empty table, or one without anchors, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, documents, shared_dir, written

#: Components of a block of anchors at most (32 MB as float64): what is broadcast at a time.
BLOCK_VALUES = 1 << 22
#: Values of one tile's candidates, and scores of one tile.
TILE_VALUES, TILE_SCORES = 1 << 19, 1 << 21
#: Positives of an anchor, negatives of a positive, and the window's lower end in percent.
POSITIVES, NEGATIVES, SHARE = 5, 5, 80

EXACT = 2.0**53
#: Stands for "no score": below all others.
NONE = np.iinfo(np.int64).min
TOP = "anchor int, slot int, score long, id long"


def rows(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, vector) of the table; where the id is divisible by 7 the label is moved on by one, modulo 10."""
    own = F.col(label).cast("long")
    moved = F.when(F.col(vec_id) % 7 == 0, (own + 1) % 10).otherwise(own)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), moved.alias("label"), F.col(vector).alias("vector")).where("label IS NOT NULL AND vector IS NOT NULL")


def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a batch that take part: ids (0 for null), whether null, labels, lengths, and all components end to end, as whole numbers in float64."""
    ids, labels, vectors = batch.column("id"), batch.column("label"), batch.column("vector")
    at = vectors.offsets.to_numpy()
    values = vectors.values.slice(int(at[0]), int(at[-1] - at[0]))
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    at = at - at[0]
    good = bad[at[1:]] == bad[at[:-1]]
    size = np.diff(at)
    with np.errstate(over="ignore"):
        x = np.nan_to_num(np.floor(256.0 * x[np.repeat(good, size)]))
    return ids.fill_null(0).to_numpy()[good], ids.is_null().to_numpy(zero_copy_only=False)[good], labels.to_numpy()[good], size[good], x


def matrix(size: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """Vectors of any lengths as rows of one width: cut or filled with 0."""
    if len(size) and (size == width).all():
        return x.reshape(len(size), width)
    out = np.zeros((len(size), width))
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    within = np.arange(len(x)) - np.repeat(at, size)
    keep = within < width
    out[np.repeat(np.arange(len(size)), size)[keep], within[keep]] = x[keep]
    return out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with their vectors as bytes; width is the power of two that holds them."""
    for batch in batches:
        ids, _, labels, size, x = whole(batch)
        at = np.concatenate([[0], np.cumsum(size)])
        raw = [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        width = [1 << max(0, int(n - 1).bit_length()) for n in size.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(width, pa.int32()), pa.array(raw, pa.binary())], ["anchor_id", "label", "width", "raw"])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b, as int64."""
    # Of each component the largest magnitudes in a and in b bound every sum, and each part of it.
    with np.errstate(over="ignore"):
        bound = float(np.abs(a).max(0, initial=0) @ np.abs(b).max(0, initial=0))
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    ints = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    s, top = ints(a) @ ints(b).T, np.iinfo(np.int64).max
    return np.clip(s, -top, top).astype(np.int64) if s.size else np.zeros(s.shape, np.int64)


def squares(a: np.ndarray) -> np.ndarray:
    """Each row's inner product with itself, as in ``product``."""
    out = np.einsum("ij,ij->i", a, a)
    large = np.flatnonzero(out >= EXACT)
    exact = out.copy()
    exact[large] = 0
    exact = exact.astype(np.int64)
    for i in large.tolist():
        exact[i] = product(a[i : i + 1], a[i : i + 1])[0, 0]
    return exact


def first(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first k of each row: largest first, of equals those that stand first. NONE is never taken."""
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
        above, equal = s > least, s == least
        take = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(1, dtype=np.int32)[:, None]))
        take &= s != NONE
    else:
        take = s != NONE
    return np.nonzero(take)


class Lists:
    """For each of n keys the first k (score, id) seen so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.null = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.ones((n, k), bool)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """At most k entries of a key at a time, entries of a key next to each other."""
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        own, slot = key[start], np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        row = np.repeat(np.arange(len(own)), np.diff(np.append(start, len(key))))
        both = [np.concatenate([old[own], new], axis=1) for old, new in ((self.score, np.full((len(own), self.k), NONE)), (self.id, np.zeros((len(own), self.k), np.int64)), (self.null, np.ones((len(own), self.k), bool)))]
        for into, value in zip(both, (score, ids, null), strict=True):
            into[row, self.k + slot] = value
        order = np.lexsort((both[1], both[2], ~both[0]), axis=1)[:, : self.k]
        self.score[own], self.id[own], self.null[own] = (np.take_along_axis(x, order, 1) for x in both)

    def batch(self, slots: int) -> pa.RecordBatch:
        """Keys are anchor * slots + slot."""
        key, at = np.nonzero(self.score != NONE)
        cols = [pa.array(key // slots, pa.int32()), pa.array(key % slots, pa.int32()), pa.array(self.score[key, at]), pa.array(self.id[key, at], mask=self.null[key, at])]
        return pa.RecordBatch.from_arrays(cols, ["anchor", "slot", "score", "id"])


def tiles(batches: Iterator[pa.RecordBatch], anchors: np.ndarray):
    """Scores of all anchors with all candidates: (first anchor, scores, ids, null, labels), candidates of a tile by id, null last."""
    width = max(1, anchors.shape[1])
    wide = max(1, TILE_VALUES // width)
    tall = max(1, TILE_SCORES // wide)
    for batch in batches:
        ids, null, labels, size, x = whole(batch)
        at = np.concatenate([[0], np.cumsum(size)])
        for a in range(0, len(ids), wide):
            b = min(len(ids), a + wide)
            m = matrix(size[a:b], x[at[a] : at[b]], anchors.shape[1])
            order = np.lexsort((ids[a:b], null[a:b]))
            m, i, n, lab = m[order], ids[a:b][order], null[a:b][order], labels[a:b][order]
            for c in range(0, len(anchors), tall):
                yield c, product(anchors[c : c + tall], m), i, n, lab


def positives(shared, k: int):
    """Map: the first k + 1 of each anchor's label, the anchor itself among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels = shared.value[:2]
        best = Lists(len(labels), k + 1)
        for c, s, ids, null, lab in tiles(batches, anchors):
            s[lab[None, :] != labels[c : c + len(s), None]] = NONE
            row, col = first(s, k + 1)
            best.add(c + row, s[row, col], ids[col], null[col])
        yield best.batch(1)

    return run


def negatives(shared, k: int, share: int):
    """Map: for each anchor and positive the first k rows of another label in the window below the positive's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, labels, low, high = shared.value
        slots = low.shape[1]
        best = Lists(len(labels) * slots, k)
        for c, s, ids, null, lab in tiles(batches, anchors):
            lo, hi = low[c : c + len(s)], high[c : c + len(s)]
            near = (s >= lo.min(1)[:, None]) & (s <= hi.max(1)[:, None]) & (lab[None, :] != labels[c : c + len(s), None])
            rows_, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(rows_):
                continue
            s = np.where(near[np.ix_(rows_, cols)], s[np.ix_(rows_, cols)], NONE)
            for w in range(slots):
                inside = np.where((s >= lo[rows_, w, None]) & (s <= hi[rows_, w, None]), s, NONE)
                row, col = first(inside, k)
                best.add((c + rows_[row]) * slots + w, s[row, col], ids[cols[col]], null[cols[col]])
        yield best.batch(slots)

    return run


def ranked(lists: DataFrame, k: int, name: str) -> DataFrame:
    """The lists of all tasks merged: the first k of each (anchor, slot), numbered from 1."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return lists.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def anchor_blocks(spark: SparkSession, anchors: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Distinct anchors with their copies, written by width and block, and the list of both."""
    distinct = anchors.groupBy("anchor_id", "label", "width", "raw").agg(F.count("*").alias("copies"))
    distinct = written(spark, distinct)
    sizes = {r.width: r.n for r in distinct.groupBy("width").agg(F.count("*").alias("n")).collect()}  # a row for each power of two
    # Blocks are filled to half on average, so that none that a hash overfills goes beyond the bound.
    count = {w: max(1, -(-2 * n * w // BLOCK_VALUES)) for w, n in sizes.items()}
    n = F.element_at(F.create_map(*[F.lit(x) for pair in count.items() for x in pair]), F.col("width")) if count else F.lit(1)
    path = shared_dir(spark)
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("anchor_id", "label", "raw"), n.cast("long")).cast("int"))
    dealt.repartition("width", "block").write.partitionBy("width", "block").parquet(path)
    out = spark.read.schema(dealt.schema).parquet(path)
    out._folder = path
    discard(distinct)
    return out, sorted((w, b) for w, m in count.items() for b in range(m))


def mine(vectors: DataFrame, every: int = 100, positive_k: int = POSITIVES, negative_k: int = NEGATIVES, share: int = SHARE) -> DataFrame:
    """Anchors are the rows whose id is divisible by ``every``; a row for each anchor, positive and negative."""
    spark = vectors.sparkSession
    table = rows(vectors)
    blocks, names = anchor_blocks(spark, table.where(F.col("id") % every == 0).mapInArrow(packed, "anchor_id long, label long, width int, raw binary"))
    out = []
    for width, block in names:
        own = blocks.where((F.col("width") == width) & (F.col("block") == block)).select("anchor_id", "label", "raw", "copies").toArrow()  # at most BLOCK_VALUES components
        if not own.num_rows:
            continue
        raw = own.column("raw").to_pylist()
        a = matrix(np.array([len(r) // 8 for r in raw]), np.frombuffer(b"".join(raw)), width)
        ids, labels, copies = (own.column(c).to_numpy() for c in ("anchor_id", "label", "copies"))
        sent = spark.sparkContext.broadcast((a, labels))
        found = ranked(table.mapInArrow(positives(sent, positive_k), TOP), positive_k + 1, "place").toArrow()  # at most 6 rows an anchor of the block
        sent.unpersist()
        own_score = squares(a)
        high, low, names_ = windows(found, ids, own_score, positive_k, share)
        sent = spark.sparkContext.broadcast((a, labels, low, high))
        best = ranked(table.mapInArrow(negatives(sent, negative_k, share), TOP), negative_k, "rank")
        told = spark.createDataFrame(names_.append_column("copies", pa.array(copies[names_.column("anchor").to_numpy()])))
        result = best.join(told, ["anchor", "slot"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        out.append(written(spark, result.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        sent.destroy()
    discard(blocks)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, out)


def windows(found: pa.Table, ids: np.ndarray, own_score: np.ndarray, k: int, share: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Ends of the windows, high and low, by anchor and slot (empty ones below all scores), and the positive of each slot."""
    place = np.argsort(found.column("anchor").to_numpy() * (k + 2) + found.column("place").to_numpy(), kind="stable")
    anchor, score = found.column("anchor").to_numpy()[place], found.column("score").to_numpy()[place]
    positive = found.column("id").combine_chunks().take(pa.array(place))
    itself = (positive.fill_null(0).to_numpy() == ids[anchor]) & positive.is_valid().to_numpy(zero_copy_only=False) & (score == own_score[anchor])
    # Entries of one id and score are alike: the first of them goes.
    before = np.concatenate([[0], np.cumsum(itself)])
    start = np.searchsorted(anchor, anchor)
    keep = ~(itself & (before[:-1] == before[start]))
    at = np.concatenate([[0], np.cumsum(keep)])
    slot = at[:-1] - at[start]
    keep &= slot < k
    anchor, slot, score, positive = anchor[keep], slot[keep], score[keep], positive.filter(pa.array(keep))
    high, low = np.full((len(ids), k), NONE), np.full((len(ids), k), np.iinfo(np.int64).max)
    high[anchor, slot] = score
    low[anchor, slot] = [-(-share * p // 100) for p in score.tolist()]  # in whole numbers of any size
    told = {"anchor": pa.array(anchor, pa.int32()), "slot": pa.array(slot, pa.int32()), "anchor_id": pa.array(ids[anchor]), "positive_id": positive, "positive_score": pa.array(score)}
    return high, low, pa.table(told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir, "embeddings"))


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS "rank", other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY "rank" <= 5
"""

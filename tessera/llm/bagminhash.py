"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of the multisets of five-word shingles.

A shingle of weight w is the stretch (0, w] of a weight axis cut into (0, 1], (1, 2], (2, 4], (4, 8] and so on. Each piece has
a Poisson process in time with the piece's width as rate, drawn from a hash of the shingle and the piece alone; a point carries a register
and a level within the piece, and counts if the level is not above w. A register keeps the first point that hits it, so two
signatures agree in a register with the probability of the multisets' weighted Jaccard similarity. Points are drawn in order of time and only up to the
horizon by which all registers are filled (doubled for the few texts for which it was too near), so most shingles draw few.

Texts of equal words are one node (equal texts, where there are no words). Signatures fall into bands; the nodes of one bucket are candidates. Bands of
6 of 144 registers miss a pair of similarity 0.8 with probability 7e-4 and take one of 0.4 with 0.09. Candidates whose registers agree less than ``LIKELY``
(five standard deviations under 0.8) are not looked at again; the others are verified on the whole multisets, in two rounds:

1. Each node with the least node it shares a bucket with. Connected components are formed.
2. Of every bucket that still holds several components, all pairs across components, in tiles of at most twice ``TILE`` nodes.

So no link between candidates is lost. Pairs within a component, of which a large group of copies has many, are not formed, and a tile tells no more
links than join its components.

Defined cases: a text of fewer than five words, but not none, is one shingle; texts without words are near only if equal (null is
empty). Repeated rows and rows with equal doc_id each get a row; null ids come out as they are, class_id is the least non-null id of the class. Very long
texts are one multiset each. Other columns are ignored by ``classes`` and kept by ``keep_one``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bwt_dedup import FILTER_BITS, bitmap
from tessera.llm.common import ALNUM, U64, Words, discard, documents, mix, pieces, utf8, written
from tessera.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, ROWS = 144, 6
#: Share of agreeing registers under which a candidate pair is not verified.
LIKELY = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Nodes of a bucket are compared in tiles of two blocks of about so many nodes and shingles.
TILE, TILE_ITEMS = 512, 1 << 20


def shingles(w: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, sorted within each row, and the n + 1 bounds of the rows."""
    h = w.hashes()
    count = np.diff(w.first)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    start = np.repeat(w.first[:-1], n) + np.arange(len(out)) - np.repeat(bounds[:-1], n)
    size = np.repeat(np.minimum(count, SHINGLE), n)
    for j in range(SHINGLE):
        more = size > j
        if more.all():
            out = out * U64(0x9E3779B97F4A7C15) + h[start + j]
        else:
            out[more] = out[more] * U64(0x9E3779B97F4A7C15) + h[start[more] + j]
    out = mix(out)
    for i in range(rows):
        out[bounds[i] : bounds[i + 1]].sort()
    return out, bounds


def unit(h: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1)."""
    return ((h >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of register values for each multiset; zeros for an empty one."""
    rows = len(bounds) - 1
    out = np.zeros((rows, REGISTERS), np.uint64)
    if not len(values):
        return out
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(values)))
    item, row = values[at], owner[at]
    low, width = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
    parts = [(item, row, weight, low, width)]
    k = 1
    while (more := weight > k).any():  # the pieces (k, 2k]
        item, row, weight = item[more], row[more], weight[more]
        parts.append((mix(item + U64(k)), row, weight, np.full(len(item), k), np.full(len(item), k)))
        k *= 2
    item, row, weight, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    horizon = REGISTERS * (np.log(REGISTERS) + 6) / np.maximum(np.diff(bounds), 1)
    first = np.full(rows * REGISTERS, np.inf)
    todo = np.diff(bounds) > 0
    while todo.any():
        use = todo[row]
        h, r, wt, lo, wd = item[use], row[use], weight[use], low[use], width[use]
        t, end = np.zeros(len(h)), horizon[r]
        while len(h):
            h = mix(h + U64(0x9E3779B97F4A7C15))
            t = t - np.log(unit(h)) / wd
            live = t <= end
            h, r, wt, lo, wd, t, end = h[live], r[live], wt[live], lo[live], wd[live], t[live], end[live]
            mark = mix(h ^ U64(0xD1B54A32D192ED03))
            ok = lo + 1 + ((mark & U64(0xFFFFFFFF)).astype(np.int64) * wd >> 32) <= wt
            slot = r * REGISTERS + ((mark >> U64(32)).astype(np.int64) * REGISTERS >> 32)
            slot, when, name = slot[ok], t[ok], mark[ok]
            np.minimum.at(first, slot, when)
            best = when == first[slot]
            out.reshape(-1)[slot[best]] = name[best]
        todo &= np.isinf(first.reshape(rows, REGISTERS)).any(1)
        horizon = horizon * 2
        first.reshape(rows, REGISTERS)[todo] = np.inf
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), REGISTERS // ROWS, ROWS)
    out = np.full(parts.shape[:2], 1, np.uint64) * mix(np.arange(1, parts.shape[1] + 1, dtype=np.uint64))
    for j in range(ROWS):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out.view(np.int64)


def keys(w: Words, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes of a digest of each row's words, or of its bytes where it has none."""
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        words = b" ".join(w.text[a:b].tobytes().split())
        out.append(hashlib.blake2b(words if words else b"\x00" + data[a:b].tobytes(), digest_size=16).digest())
    return out


def distinct_items(sorted_values: np.ndarray) -> np.ndarray:
    """A sorted multiset as a sorted set: the second and later occurrences of a value get values of their own."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    if new.all():
        return sorted_values
    place = np.arange(len(new))
    nth = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return np.sort(np.where(nth > 0, mix(sorted_values + nth * U64(0x9E3779B97F4A7C15)), sorted_values))


def multiset_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets as distinct_items gives them."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key and bands of each text, after the columns other than the text."""
    for batch in batches:
        names = [c for c in batch.schema.names if c != "text"]
        data, offsets = utf8(batch.column("text"))
        for a, b in pieces(offsets, 4 << 20):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            w = Words(own, at, ALNUM)
            values, bounds = shingles(w, b - a)
            registers = signatures(values, bounds)
            made = bands(registers)
            full = np.diff(bounds) > 0
            ends = np.concatenate([[0], np.cumsum(full * made.shape[1])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made[full].reshape(-1)))
            sig = pa.array([x.tobytes() for x in (registers & U64(255)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), pa.array(keys(w, own, at), pa.binary()), lists, pa.array(np.diff(bounds), pa.int32()), sig], [*names, "key", "bands", "size", "sig"])


def rows_of(sig: pa.Array) -> np.ndarray:
    """Signatures, a byte of each register, as a matrix."""
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures are near enough to be verified."""
    for batch in batches:
        near = (rows_of(batch.column("sa")) == rows_of(batch.column("sb"))).mean(1) >= LIKELY
        yield batch.select(["a", "b"]).filter(pa.array(near))


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("sa"), batch.column("sb")
        keep = [multiset_jaccard(np.frombuffer(a[i].as_py(), np.uint64), np.frombuffer(b[i].as_py(), np.uint64)) >= SIMILARITY for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def multisets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and items of the texts with the wanted keys. A bitmap of fixed size spares most of the other texts the work."""
    bits = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    slots = bitmap(wanted.select(F.shiftleft(bits, 32).alias("akey")))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out: dict[bytes, bytes] = {}
            for a, b in pieces(offsets, 4 << 20):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                w = Words(own, at, ALNUM)
                for i, k in enumerate(keys(w, own, at)):
                    if known[int.from_bytes(k[:4], "big") >> (32 - FILTER_BITS)] and k not in out:
                        text = own[at[i] : at[i + 1]]
                        out[k] = distinct_items(shingles(Words(text, np.array([0, len(text)]), ALNUM), 1)[0]).tobytes()
            names = list(out)
            for x in range(0, len(names), 500):
                yield pa.RecordBatch.from_arrays([pa.array(names[x : x + 500], pa.binary()), pa.array([out[k] for k in names[x : x + 500]], pa.binary())], ["key", "items"])

    return docs.select("text").mapInArrow(run, "key binary, items binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) that are at least SIMILARITY alike. A node with very many partners is split by the engine's skew join."""
    items = lambda name: full.select(F.col("key").alias(name), F.col("items").alias(f"s{name}"))
    return pairs.join(items("b"), "b").join(items("a"), "a").select("a", "b", "sa", "sb").mapInArrow(similar, "a binary, b binary")


TILED = "band long, x int, y int, block int, key binary, root binary"


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole tiles, from rows sorted by (band, x, y)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = table.slice(table.num_rows - 1)
        other = np.zeros(table.num_rows, bool)
        for c in ("band", "x", "y"):
            other |= table[c].to_numpy() != last[c][0].as_py()
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def tile_rows(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each tile its rows (from, to), their components, those outside the most common component, and which rows each of these may meet."""
    tile = np.stack([table[c].to_numpy() for c in ("band", "x", "y")], 1)
    cuts = np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]).any(1)) + 1, [len(tile)]])
    block = table["block"].to_numpy()
    root = np.unique(np.array(table["root"].to_pylist(), dtype="S16"), return_inverse=True)[1]
    for s, e in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        own, local = np.unique(root[s:e], return_inverse=True)
        if len(own) < 2:
            continue
        out = np.flatnonzero(local != np.bincount(local).argmax())
        meets = local[out][:, None] != local
        if tile[s, 1] != tile[s, 2]:
            meets &= block[s:e][out][:, None] != block[s:e]
        yield s, e, local, out, meets


def likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of tiles whose signatures are near one of another component in the tile."""
    for table in tiles(batches):
        sig = rows_of(table["sig"])
        keep = np.zeros(len(sig), bool)
        for s, e, _, out, meets in tile_rows(table):
            for i, row in zip(out.tolist(), meets, strict=True):
                j = np.flatnonzero(row) + s
                j = j[(sig[j] == sig[s + i]).mean(1) >= LIKELY]
                keep[j] = True
                keep[s + i] |= len(j) > 0
        yield from table.select([c.split()[0] for c in TILED.split(", ")]).filter(pa.array(keep)).to_batches()


def link_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across the components of each tile, as many as join them (a pair that the tile has joined already is not told again). Common items are
    counted by an inverted index of the tile."""
    for table in tiles(batches):
        keys = table["key"].to_pylist()
        items = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        a: list[bytes] = []
        b: list[bytes] = []
        for s, e, local, out, meets in tile_rows(table):
            own = items[s:e]
            size = np.array([len(x) for x in own])
            flat = np.concatenate(own)
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(e - s), size)[order]
            value, first, count = np.unique(flat[order], return_index=True, return_counts=True)
            joined = local.copy()
            for i, row in zip(out.tolist(), meets, strict=True):
                at = np.searchsorted(value, own[i])
                n = count[at]
                ends = np.cumsum(n)
                both = np.bincount(owner[np.repeat(first[at] - (ends - n), n) + np.arange(int(ends[-1]))], minlength=e - s)
                near = row & (both >= SIMILARITY * (size + size[i] - both))
                for j in np.flatnonzero(near).tolist():
                    if joined[i] != joined[j]:
                        joined[joined == joined[j]] = joined[i]
                        a.append(keys[s + i])
                        b.append(keys[s + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def across(members: DataFrame, nodes: DataFrame, roots: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) between different components of nodes that share a bucket of three or more."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.select("key", "size").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "size", F.coalesce("root", "key").alias("root"))
    met = written(spark, members.join(placed, "key"))
    mixed = met.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("n > 2 AND lo <> hi")
    mixed = written(spark, mixed.select("band", F.ceil(F.greatest(F.col("n") / TILE, F.col("size") / TILE_ITEMS)).cast("int").alias("blocks")))
    rows = met.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "key", "root")
    sorted_ = lambda df: df.repartition(parts, "band", "x", "y").sortWithinPartitions("band", "x", "y")
    near = written(spark, sorted_(rows.join(nodes.select("key", "sig"), "key")).mapInArrow(likely_rows, TILED))
    out = written(spark, sorted_(near.join(full, "key")).mapInArrow(link_tiles, "a binary, b binary"))
    discard(met, mixed, near)
    return out


def rooted(docs: DataFrame, kept: str) -> DataFrame:
    """The columns of ``kept`` (a schema) and the root of its class for every document."""
    spark = docs.sparkSession
    signed = written(spark, docs.mapInArrow(sign, f"{kept}, key binary, bands array<long>, size int, sig binary"))
    nodes = written(spark, signed.select("key", "bands", "size", "sig").where("size(bands) > 0").dropDuplicates(["key"]))
    banded = nodes.select("key", F.explode("bands").alias("band"))
    shared = written(spark, banded.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least"))
    members = written(spark, banded.join(shared, "band").select("band", "least", "key"))
    sig = lambda name: nodes.select(F.col("key").alias(name), F.col("sig").alias(f"s{name}"))
    star = members.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    star = written(spark, star.join(sig("b"), "b").join(sig("a"), "a").select("a", "b", "sa", "sb").mapInArrow(likely, "a binary, b binary"))
    full = written(spark, multisets(docs, members.select("key").distinct()))
    links = written(spark, verified(star.groupBy("b").agg(F.min("a").alias("a")), full))
    roots = written(spark, components(spark, links))
    root_of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    again = star.join(root_of("b"), "b", "left").join(root_of("a"), "a", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    more = written(spark, verified(again, full))
    tiled = across(members.select("band", "key"), nodes, roots, full)
    if not (more.isEmpty() and tiled.isEmpty()):
        roots = written(spark, components(spark, links.union(more).union(tiled)))
    out = written(spark, signed.drop("bands", "size", "sig").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).drop("key"))
    discard(signed, nodes, shared, members, star, full, links, more, tiled, roots)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_class for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = rooted(docs, "doc_id long")
    # The few classes of several rows are a table of their own, so the join can split the rows of a large class.
    size = written(docs.sparkSession, own.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_class")).where("n_class > 1"))
    alone = F.col("n_class").isNull()
    return own.join(size, "root", "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, columns unchanged: that of least doc_id (nulls last), then of least digest of its text. Of rows
    of equal id and text one stays. Nulls, empty texts and repeats are as the module says; columns may have any name."""
    spark = docs.sparkSession
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    id_, text = F.col("row.doc_id").cast("long"), F.col("row.text").cast("string")
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    own = rooted(row.select(id_.alias("id"), digest.alias("digest"), text.alias("text")), "id long, digest binary")
    marked = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("k"), F.count("*").alias("n"))
    kept = written(spark, marked.select(F.col("k.id").alias("kept_id"), F.col("k.digest").alias("kept")))
    out = row.withColumns({"id": id_, "digest": digest}).join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept")), "left_semi")
    if own.groupBy("id", "digest").count().where("count > 1").limit(1).count():  # rows of equal id and text
        out = out.dropDuplicates(["id", "digest"])
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))

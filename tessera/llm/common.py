"""Byte-level helpers shared by the operators: Arrow text as numpy arrays, hashing, word scanning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, span = h, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[: len(h) - width + 1], out[width - span :])


def word_table(word: bytes) -> np.ndarray:
    """Byte map that lower-cases A-Z and turns all but the given bytes and those over 127 into blanks."""
    out = np.full(256, 32, np.uint8)
    keep = np.frombuffer(word, np.uint8)
    out[keep] = keep
    out[128:] = np.arange(128, 256)
    out[65:91] = np.where(out[97:123] != 32, np.arange(97, 123), 32)
    return out


#: Words of letters, digits and any character over 127.
ALNUM = word_table(bytes([*range(48, 58), *range(97, 123)]))
#: Words of all but white space.
NONSPACE = word_table(bytes(b for b in range(128) if b not in (32, *range(9, 14)) and not 65 <= b <= 90))

def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = powers(256)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


class Words:
    """Words of a run of texts: byte ranges, the row of each, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.text = low = table[data]
        inside = low != 32
        edge = np.ones(len(low) + 1, bool)
        if len(low):
            edge[1:-1] = inside[1:] != inside[:-1]
            edge[offsets[:-1][offsets[:-1] < len(low)]] = True
            edge[0] = edge[-1] = True
        cuts = np.flatnonzero(edge)
        if len(low):
            word = inside[cuts[:-1]]
            self.start, self.end = cuts[:-1][word], cuts[1:][word]
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: Words of row i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        at = np.concatenate([[0], np.cumsum(length)[:-1]])
        within = np.arange(int(length.sum())) - np.repeat(at, length)
        pw = _POW if int(length.max()) <= 256 else powers(int(length.max()))
        terms = _BYTE[self.text[self.inside]] * pw[within]
        return mix(np.add.reduceat(terms, at) + length.astype(np.uint64))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share. Only a local master may do without that setting."""
    import tempfile
    import uuid

    base = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = base.get() if base.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root}/tessera-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The frame, computed once and read again from the shared folder, which cuts its lineage."""
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the folders of written frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_folder", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

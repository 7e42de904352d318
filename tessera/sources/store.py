"""A log-structured table of rows by key on plain Parquet.

Every write is a delta: a folder ``delta/batch=N/bucket=B`` with the rows of that batch alone, so what a batch costs follows the batch and not the table. A batch that is
written again replaces itself. Readers merge: of each key the newest machine columns, the newest human columns, and the newest removal count, each by its batch number.
That merge is associative, so a bucket whose deltas have become many is rewritten as one ``base`` (``compact``); a manifest, itself a folder that is whole or not at all, says up
to which batch each bucket's base goes. Nothing is deleted by a compaction, so readers of the former manifest go on; ``vacuum`` deletes.

Two kinds of columns: machine columns, which a later write replaces together, and human columns, which only ``amend`` sets and which later writes keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    """``schema`` has the key's and the machine columns; ``human`` maps a column to its type and default. At most one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: list[str], human: dict[str, tuple[str, object]] | None = None, buckets: int = 16, most: int = 8):
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.spark, self.folder, self.key, self.human, self.buckets, self.most = spark, folder.rstrip("/"), key, human or {}, buckets, most
        self.machine = [f.name for f in schema if f.name not in key]
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        machine = ",".join(f"{c}:{kinds[c]}" for c in self.machine)
        human_kinds = ",".join(f"{c}:{t}" for c, (t, _) in self.human.items()) or "none:boolean"
        self.machine_type, self.human_type = f"struct<{machine}>", f"struct<{human_kinds}>"
        # Batches: f of the first put since the last removal, m of the last one, h of the human columns, g of the removal.
        self.stored = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), f"machine {self.machine_type}", f"human {self.human_type}", "f long", "m long", "h long", "g long"])

    # --- writing ---

    def _delta(self, batch: int, rows: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        rows.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/delta/batch={batch:012d}")

    def _row(self, machine=None, human=None, m=None, h=None, g=None):
        none = F.lit(None)
        return [
            *self.key, (none.cast(self.machine_type) if machine is None else machine).alias("machine"), (none.cast(self.human_type) if human is None else human).alias("human"),
            *[(none if v is None else F.lit(v)).cast("long").alias(n) for n, v in (("f", m), ("m", m), ("h", h), ("g", g))],
        ]

    def put(self, batch: int, rows: DataFrame) -> None:
        """New and changed rows; of rows with one key in a batch the greatest counts, so a repeated batch is the same. Human columns stay."""
        one = rows.groupBy(*self.key).agg(F.max(F.struct(*self.machine)).alias("v"))
        self._delta(batch, one.select(*self._row(machine=F.col("v").cast(self.machine_type), m=batch)))

    def amend(self, batch: int, rows: DataFrame) -> None:
        """Human columns of the keys that are there; of others nothing comes of it."""
        one = rows.groupBy(*self.key).agg(F.max(F.struct(*self.human)).alias("v"))
        self._delta(batch, one.select(*self._row(human=F.col("v").cast(self.human_type), h=batch)))

    def remove(self, batch: int, keys: DataFrame) -> None:
        """Q06: keys that go, with all their columns, until they are put again."""
        self._delta(batch, keys.select(*self.key).distinct().select(*self._row(g=batch)))

    # --- reading ---

    def _path(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str, prefix: str, whole: bool = True) -> list[int]:
        """Numbers of the folders prefix=N that were finished."""
        path, fs = self._path(folder)
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{prefix}=")]
        done = [p for p in found if not whole or fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def batches(self) -> list[int]:
        return self._names(f"{self.folder}/delta", "batch")

    def manifest(self) -> dict[int, tuple[int, int]]:
        """For each bucket that has a base, the last batch that is in it and the base's version."""
        found = self._names(f"{self.folder}/manifest", "version")
        if not found:
            return {}
        rows = self.spark.read.schema("bucket int, batch long, version int").json(f"{self.folder}/manifest/version={found[-1]:06d}").collect()  # a row a bucket
        return {r.bucket: (r.batch, r.version) for r in rows}

    def _rows(self, bases: dict[int, tuple[int, int]], only: list[int] | None = None) -> DataFrame:
        """All rows that count, unmerged: bases, and the deltas that are newer than their bucket's. Both are chosen by their folders."""
        kind = f"{self.stored}, bucket int"
        empty = self.spark.createDataFrame([], kind)
        parts = [empty]
        if (numbers := self.batches()):
            low = min((b for b, _ in bases.values()), default=-1) if len(bases) == self.buckets else -1
            paths = [f"{self.folder}/delta/batch={n:012d}" for n in numbers if n > low]
            if paths:
                deltas = self.spark.read.schema(f"{kind}, batch long").option("basePath", f"{self.folder}/delta").parquet(*paths)
                old = [(F.col("bucket") == b) & (F.col("batch") <= n) for b, (n, _) in bases.items()]
                for test in old:
                    deltas = deltas.where(~test)
                parts.append(deltas.drop("batch"))
        for version in sorted({v for _, v in bases.values()}):
            own = [b for b, (_, v) in bases.items() if v == version]
            base = self.spark.read.schema(kind).option("basePath", f"{self.folder}/base/version={version:06d}").parquet(f"{self.folder}/base/version={version:06d}")
            parts.append(base.where(F.col("bucket").isin(own)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p.select(*out.columns))
        return out if only is None else out.where(F.col("bucket").isin(only))

    def _merged(self, rows: DataFrame) -> DataFrame:
        """A row for each key that is there, in the form that is stored. A base goes before all deltas that are read with it, so the puts of a key are a few ranges of batches."""
        newest = lambda v, n: F.max_by(v, n).alias(v)
        puts = F.collect_list(F.when(F.col("m").isNotNull(), F.struct("f", "m"))).alias("puts")
        all_ = rows.groupBy(*self.key, "bucket").agg(newest("machine", "m"), newest("human", "h"), F.max("m").alias("m"), F.max("h").alias("h"), F.max("g").alias("g"), puts)
        since = F.coalesce("g", F.lit(-1))
        there = all_.where(F.col("m") > since).withColumn("f", F.array_min(F.transform(F.filter("puts", lambda p: p.m > since), lambda p: p.f)))
        own = F.col("h") > F.col("f")
        return there.select(*self.key, "machine", F.when(own, F.col("human")).alias("human"), "f", "m", F.when(own, F.col("h")).alias("h"), F.lit(None).cast("long").alias("g"), "bucket")

    def read(self) -> DataFrame:
        """The table as it stands."""
        human = [F.coalesce(F.when(F.col("h").isNotNull(), F.col(f"human.{c}")), F.lit(d).cast(t)).alias(c) for c, (t, d) in self.human.items()]
        return self._merged(self._rows(self.manifest())).select(*self.key, *[F.col(f"machine.{c}").alias(c) for c in self.machine], *human)

    # --- upkeep ---

    def compact(self, force: bool = False) -> list[int]:
        """Rewrite the buckets with more than ``most`` deltas above their base (``force``: with any); returns them."""
        numbers, bases = self.batches(), self.manifest()
        count = dict.fromkeys(range(self.buckets), 0)
        for n in numbers:
            for b in self._names(f"{self.folder}/delta/batch={n:012d}", "bucket", whole=False):
                count[b] += n > bases.get(b, (-1, 0))[0]
        due = [b for b, c in count.items() if c > (0 if force else self.most)]
        if not due:
            return []
        versions = self._names(f"{self.folder}/manifest", "version")
        version = versions[-1] + 1 if versions else 1
        self._merged(self._rows(bases, due)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base/version={version:06d}")
        after = bases | {b: (numbers[-1], version) for b in due}
        rows = [(b, n, v) for b, (n, v) in after.items()]
        self.spark.createDataFrame(rows, "bucket int, batch long, version int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/version={version:06d}")
        return due

    def vacuum(self) -> None:
        """Delete what the newest manifest does not need: deltas that every bucket's base has, older bases and manifests."""
        bases, versions = self.manifest(), self._names(f"{self.folder}/manifest", "version")
        if not versions:
            return
        low = min(n for n, _ in bases.values()) if len(bases) == self.buckets else -1
        gone = [f"delta/batch={n:012d}" for n in self.batches() if n <= low]
        gone += [f"base/version={v:06d}" for v in self._names(f"{self.folder}/base", "version") if v not in {x for _, x in bases.values()}]
        gone += [f"manifest/version={v:06d}" for v in versions[:-1]]
        for name in gone:
            path, fs = self._path(f"{self.folder}/{name}")
            fs.delete(path, True)

"""Readers and sinks. Rasterising, OCR, office formats and networks stay outside; their output comes in as tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh name under spark.checkpoint.dir, which driver and executors share. Only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base}/library-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The frame, computed once and read again from the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the folders of written frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_folder", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; an unknown one is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("txt", "md"):
        return spark.read.text(path, wholetext=True)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind in ("png", "jpg", "jpeg", "pdf"):
        return spark.read.format("binaryFile").load(path)
    raise ValueError(f"no reader for {path}")


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without blank ones and comments."""
    lines = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(#|$)")))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def last_per_key(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """JSON lines by key, the last line of each, broken lines dropped. The last is that of the last file by name, and within a file the one that stands last."""
    # Within a split rows come in order, and splits of a file by where they begin.
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select(at.alias("n_"), "value")
    rows = lines.select("n_", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where(F.col("r").isNotNull()).select("n_", "r.*")
    keep = [F.col(k).isNotNull() for k in key]
    for k in keep:
        rows = rows.where(k)
    rest = [c for c in rows.columns if c not in (*key, "n_")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "n_").alias("v")).select(*key, "v.*")


def resolve_names(wanted: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """Files by name, composed and decomposed spellings alike; every wanted name once, path null where there is none."""
    key = T.composed(F.col(name))
    have = files.withColumn("key_", key).groupBy("key_").agg(F.min("path").alias("path"))
    return wanted.withColumn("key_", key).join(have, "key_", "left").drop("key_")


def hints(path: Column, root: str) -> Column:
    """Subject and unit from the folders above a file, where there are at least two below the root; else empty."""
    parts = F.split(F.regexp_replace(path, "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", ""), "/")
    deep = F.size(parts) >= 3
    return F.struct(F.when(deep, F.get(parts, F.lit(0))).otherwise("").alias("subject"), F.when(deep, F.get(parts, F.lit(1))).otherwise("").alias("unit"))


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """PNG files of a tree with id, hints and whether they are whole; those under a folder _FAILED are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(folder).where(~F.contains("path", F.lit("/_FAILED/")))
    whole = F.substring("content", 1, 4) == F.unhex(F.lit("89504E47"))
    return files.select(F.substring(F.sha2("content", 256), 1, 16).alias("id"), "path", hints(F.col("path"), folder).alias("h"), whole.alias("whole")).select("id", "path", "h.*", "whole")


def ingest(files: DataFrame, known: DataFrame) -> DataFrame:
    """Whole files whose id is not known yet, one row an id (the least path)."""
    new = files.where("whole").groupBy("id").agg(F.min(F.struct("path", "subject", "unit")).alias("f")).select("id", "f.*")
    return new.join(known.select("id"), "id", "left_anti")


def ingest_counts(files: DataFrame, known: DataFrame) -> DataFrame:
    """One row: added, skipped (known, or the same content again), failed (broken)."""
    seen = known.select("id").distinct().withColumn("old", F.lit(True))
    per = files.groupBy("id").agg(F.count_if("whole").alias("good"), F.count_if(~F.col("whole")).alias("bad")).join(seen, "id", "left")
    added = ((F.col("good") > 0) & F.col("old").isNull()).cast("long")
    return per.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((added, "added"), (F.col("good") - added, "skipped"), (F.col("bad"), "failed"))])


def split_prefix(df: DataFrame, text: str, share: float = 0.9) -> DataFrame:
    """Each text as its first share of characters and the rest."""
    n = F.floor(F.length(text) * share).cast("int")
    return df.withColumns({"train": F.substring(F.col(text), F.lit(1), n), "held": F.substring(F.col(text), n + 1, F.length(text))})


def split_corpus(df: DataFrame, order: str, text: str, share: float = 0.9) -> DataFrame:
    """The bytes of all texts, one after another by ``order`` (null first, equal ones by a hash of the text), cut once: ``train`` has each row's bytes before the cut, ``held`` those after
    it. Null texts have no bytes. The cut is found by a prefix scan over lengths alone; then each text is on one side of it, or is cut, where it stands, so no text is moved."""
    from tessera.operators import prefix

    raw = F.coalesce(F.encode(text, "utf-8"), F.unhex(F.lit("")))
    size = F.octet_length(raw).cast("long")
    sized = df.select(F.col(order).alias("o_"), F.xxhash64(text).alias("h_"), size.alias("n_"))
    total = sized.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]
    cut = int(total * share)
    scan = prefix.ranged(sized, [], ["o_", "h_"]).running(from_=("sum", F.col("n_"), False)).rows
    at = scan.where((F.col("from_") <= cut) & (cut < F.col("from_") + F.col("n_"))).first()
    parts = lambda n: {"train": F.substring(raw, F.lit(1), n), "held": F.substring(raw, n + 1, F.octet_length(raw))}
    if at is None:  # no bytes, or all of them before the cut
        return df.withColumns(parts(F.octet_length(raw)))
    kind = scan.schema["o_"].dataType
    here, edge = F.struct(F.col(order).alias("o"), F.xxhash64(text).alias("h")), F.struct(F.lit(at["o_"]).cast(kind).alias("o"), F.lit(at["h_"]).alias("h"))
    clear = df.where(here != edge).withColumns(parts(F.when(here < edge, F.octet_length(raw)).otherwise(0)))
    # Rows that are the one that is cut, or equal to it, are told apart by a number.
    first = scan.where(F.col("o_").eqNullSafe(F.lit(at["o_"]).cast(kind)) & (F.col("h_") == at["h_"])).agg(F.min("from_")).first()[0]
    equal = prefix.ranged(df.where(here == edge), [], [order]).running(nth_=("sum", F.lit(1), False)).rows
    n = F.greatest(F.lit(0), F.least(size, F.lit(cut - first) - F.col("nth_") * size)).cast("int")
    return clear.unionByName(equal.withColumns(parts(n)).drop("nth_"))


def not_yet(wanted: DataFrame, have: DataFrame, key: str = "name") -> DataFrame:
    """S16's resume: what is wanted and not there, or there with no bytes."""
    return wanted.join(have.where("nbytes > 0").select(key), key, "left_anti")


def with_cache(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache, and the rest."""
    return requests.join(cache, key), requests.join(cache, key, "left_anti")


def coalesce_text(*sources):
    """The first source with more than white space."""
    return F.coalesce(*[F.nullif(F.regexp_replace(s, r"(?U)\A\s+|\s+\z", ""), F.lit("")) for s in sources], F.lit(""))


def save_json(df: DataFrame, path: str) -> None:
    """K11."""
    df.write.mode("overwrite").json(path)


def export(items: DataFrame, path: str, status: str = "confirmed") -> DataFrame:
    """Items of a status as JSON lines, by subject, unit and id; returns the rows in that order."""
    out = items.where(F.col("status") == status).orderBy("gold_subject", "gold_unit", "id")
    out.write.mode("overwrite").json(path)
    return out


def save_weights(spark: SparkSession, weights: dict, folder: str) -> str:
    """Weights as JSON in a folder of their own, which is there whole or not at all; the newest version counts."""
    rows = [(k, float(v)) for k, v in weights["coefficients"].items()]
    row = spark.createDataFrame([(weights["source"], dict(rows), float(weights["intercept"]), int(weights.get("n_samples", 0)))], "source string, coefficients map<string,double>, intercept double, n_samples long")
    path = f"{folder}/version={len(versions(spark, folder)) + 1:06d}"
    row.coalesce(1).write.json(path)
    return path


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Finished versions below a folder, oldest first."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    return sorted(p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def load_weights(spark: SparkSession, folder: str) -> dict | None:
    """The newest weights, if they were learned from reviewed labels and are whole; else none."""
    found = versions(spark, folder)
    row = spark.read.schema("source string, coefficients map<string,double>, intercept double, n_samples long").json(found[-1]).first() if found else None
    if row is None or row.source != "gold" or row.coefficients is None or row.intercept is None:
        return None
    return row.asDict()


def capture_names(rows: DataFrame, stem: Column) -> DataFrame:
    """One file name for each capture, stem_p<page>_q<number>, and _2, _3 for further ones of the same page and number (by ``seq``)."""
    rows = rows.withColumns({"stem": F.coalesce(F.nullif(stem, F.lit("")), F.lit("answers")), "num": F.coalesce("num", F.lit("p"))})
    from tessera.operators import prefix

    rows = prefix.ranged(rows, ["stem", "page", "num"], ["seq"]).running(k_=("sum", F.lit(1), True)).rows
    more = F.when(F.col("k_") > 1, F.concat(F.lit("_"), F.col("k_").cast("string"))).otherwise("")
    return rows.withColumn("file", F.concat("stem", F.lit("/"), "stem", F.lit("_p"), F.coalesce(F.col("page"), F.lit(0)).cast("string"), F.lit("_q"), "num", more, F.lit(".png"))).drop("k_", "stem")


def append(df: DataFrame, path: str) -> None:
    """K12."""
    df.write.mode("append").parquet(path)

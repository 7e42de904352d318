"""Review log: snapshots instead of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.operators import prefix

KEY = ["source", "page", "num"]
#: Q01: the tables of the review loop.
TABLES = {
    "review_log": "source string, page int, num string, set_id string, image_id string, reason string, subject string, sub_subject string, confidence double, telemetry string, resolved boolean, gold_subject string, created_at timestamp",
    "items": "id string, path string, status string, pred_subject string, gold_subject string, gold_unit string, note string, created_at timestamp",
    "cache": "key string, reply string, budget int, nbytes long, ts timestamp",
    "events": "at timestamp, kind string, batch long, payload string",
}


def create(spark: SparkSession, folder: str) -> list[str]:
    """Q01: the tables that are not there yet, empty; returns the names of those made."""
    made = []
    for name, kind in TABLES.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            spark.createDataFrame([], kind).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made

HUMAN = {"resolved": "boolean", "gold_subject": "string"}


#: Columns that were added to the log over time: type and default.
ADDED = {"set_id": ("string", ""), "image_id": ("string", ""), "telemetry": ("string", "{}"), "resolved": ("boolean", False)}


def evolve(df: DataFrame, added: dict[str, tuple] = ADDED) -> DataFrame:
    """Q02: columns that an older snapshot lacks, filled with their defaults; those it has stay as they are."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in added.items() if c not in df.columns})


def upsert(log: DataFrame, batch: DataFrame, key: list[str] = KEY, human: tuple[str, ...] = tuple(HUMAN)) -> DataFrame:
    """The batch's machine columns over the log's, its human columns kept; other rows of the log stay. One full outer join."""
    old, new = log.alias("o"), batch.withColumn("new_", F.lit(True)).alias("n")
    joined = old.join(new, key, "full_outer")
    machine = [c for c in log.columns if c not in key and c not in human]
    return joined.select(*key, *[F.when(F.col("new_"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in machine], F.coalesce("o.resolved", F.lit(False)).alias("resolved"), F.coalesce("o.gold_subject", F.lit("")).alias("gold_subject"))


def resolve(log: DataFrame, answers: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows whose key has an answer become resolved with it."""
    found = log.join(answers.select(*key, F.col("gold").alias("gold_")), key, "left")
    return found.withColumn("resolved", F.col("resolved") | F.col("gold_").isNotNull()).withColumn("gold_subject", F.coalesce("gold_", "gold_subject")).drop("gold_")


def queue(log: DataFrame, limit: int = 50, tie: str = "num", source: str | None = None) -> DataFrame:
    """Q04: unresolved rows, of one source if it is given, least confident first (null before all), then newest."""
    rows = log if source is None else log.where(F.col("source") == source)
    return rows.where("NOT resolved").orderBy(F.asc_nulls_first("confidence"), F.desc("created_at"), tie).limit(limit)


def clear_resolved(log: DataFrame) -> DataFrame:
    return log.where("NOT resolved")


def changes(log: DataFrame, answers: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Q05/Q06: one row: how many rows of the log ``resolve`` changes with the answers, and how many ``clear_resolved`` then removes."""
    hit = log.join(answers.select(*key).distinct().withColumn("hit_", F.lit(True)), key, "left")
    return hit.agg(F.count_if(F.col("hit_")).alias("updated"), F.count_if(F.col("hit_") | F.col("resolved")).alias("cleared"))


def stats(log: DataFrame) -> DataFrame:
    """Totals, and the pending rows by reason."""
    return log.groupBy("reason").agg(F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("pending"))


def auto_review(items: DataFrame) -> DataFrame:
    """A given label before a predicted one; without either pending."""
    gold, pred = F.nullif(F.col("gold"), F.lit("")), F.nullif(F.col("pred"), F.lit(""))
    return items.withColumn("final", F.coalesce(gold, pred)).withColumn("status", F.when(F.col("final").isNull(), "pending").otherwise("confirmed")).withColumn("note", F.when(gold.isNotNull(), "hint").when(pred.isNotNull(), "auto").otherwise(""))


def evict(cache: DataFrame, cap: int, buckets: int = 1024) -> DataFrame:
    """The newest entries up to a number of bytes in all, and the newest always. Bytes are summed by ranges of ts (at most ``buckets``); only the
    range in which the cap is reached is put in order."""
    at = F.col("ts").cast("timestamp").cast("double") if cache.schema["ts"].dataType.typeName().startswith("timestamp") else F.col("ts")
    ends = cache.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.max(F.struct("ts", "key")).alias("newest"))
    lo, hi, newest = (ends.select(c).scalar() for c in ("lo", "hi", "newest"))
    of = F.least(F.floor((hi - at) / F.greatest((hi - lo) / buckets, F.lit(1e-9))), F.lit(buckets - 1)).cast("int")
    rows = cache.withColumn("b_", of)
    sums = rows.groupBy("b_").agg(F.sum("nbytes").alias("n_"))
    sums = sums.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before_") <= cap)
    near = rows.join(F.broadcast(sums), "b_")  # at most ``buckets`` rows
    w = Window.partitionBy("b_").orderBy(F.desc("ts"), F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    whole = near.where(F.col("before_") + F.col("n_") <= cap).select(*cache.columns)
    cut = near.where(F.col("before_") + F.col("n_") > cap).withColumn("sum_", F.col("before_") + F.sum("nbytes").over(w))
    return whole.union(cut.where((F.col("sum_") <= cap) | (F.struct("ts", "key") == newest)).select(*cache.columns))


def evict_tasks(tasks: DataFrame, most: int = 50, cap: int = 200 << 20) -> DataFrame:
    """A registry (task, started, status, nbytes of captures): beyond ``most`` tasks the oldest finished ones go, then, beyond ``cap`` bytes in all, the captures of the oldest
    finished ones (nbytes 0). Both orders are prefix scans over ranges of (started, task)."""
    done = F.col("status").isin("completed", "failed")
    rows = prefix.ranged(tasks, [], ["started", "task"]).running(nth_=("sum", done.cast("int"), True))
    n = rows.rows.count()
    kept = ~(done & (F.col("nth_") <= n - most))
    rows = rows.running(gone_=("sum", F.when(done & kept, F.col("nbytes")).otherwise(0), False))
    left = rows.rows.where(kept)
    all_ = left.agg(F.coalesce(F.sum("nbytes"), F.lit(0))).first()[0]
    return left.withColumn("nbytes", F.when(done & (F.lit(all_) - F.col("gone_") > cap), 0).otherwise(F.col("nbytes"))).drop("nth_", "gone_")


def total_bytes(cache: DataFrame, column: str = "nbytes") -> DataFrame:
    """The bytes of a cache, 0 for an empty one."""
    return cache.agg(F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("nbytes"))


def capture_bytes(captures: DataFrame, by: list[str]) -> DataFrame:
    """Characters of the encoded captures of each task."""
    return captures.groupBy(*by).agg(F.coalesce(F.sum(F.length("image_b64")), F.lit(0)).cast("long").alias("n"))


def captures_of(captures: DataFrame, task: str) -> DataFrame:
    """The captures of a task in order; none is an empty frame."""
    return captures.where(F.col("task") == task).orderBy("index")


def latest(puts: DataFrame, key: str = "key", at: str = "ts") -> DataFrame:
    """The last value put under each key."""
    rest = [c for c in puts.columns if c != key]
    return puts.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("v")).select(key, "v.*")


def file_parts(name: Column) -> tuple[Column, Column, Column]:
    """stem, page and number of a name like stem_p3_q7; nulls without the marks."""
    p = r"^(.*)_p(\d+)_q(\d+)"
    part = lambda k: F.nullif(F.regexp_extract(name, p, k), F.lit(""))
    return part(1), part(2).cast("int"), part(3).cast("int")


def link_predictions(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Items (id, name) of file names like stem_p3_q7 with the prediction of the same stem, page and number; of several the first by file. Items without one have nulls, items
    whose name has no marks are ``skipped``."""
    stem, page, num = file_parts(F.col("name"))
    rows = items.withColumns({"stem": stem, "page": page, "num": num.cast("string")})
    own = F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.[^.]*$", "")
    given = predictions.withColumn("stem", own).groupBy("stem", "page", "num").agg(F.min(F.struct("file", "subject", "sub_subject", "confidence")).alias("p"))
    return rows.join(given, ["stem", "page", "num"], "left").select("id", "stem", "page", "num", F.col("p.subject").alias("subject"), F.col("p.sub_subject").alias("sub_subject"), F.col("p.confidence").alias("confidence"), F.col("stem").isNull().alias("skipped"))


def link_counts(linked: DataFrame) -> DataFrame:
    """Updated, unmatched and skipped items, one row."""
    return linked.agg(F.count_if(F.col("subject").isNotNull()).alias("updated"), F.count_if(F.col("subject").isNull() & ~F.col("skipped")).alias("unmatched"), F.count_if("skipped").alias("skipped"))


def correct(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Q16: items whose id has an answer (subject, unit) become confirmed by hand."""
    found = items.join(answers.select("id", F.col("subject").alias("s_"), F.coalesce("unit", F.lit("")).alias("u_")), "id", "left")
    hit = F.col("s_").isNotNull()
    return found.withColumns({"status": F.when(hit, "confirmed").otherwise(F.col("status")), "gold_subject": F.coalesce("s_", "gold_subject"), "gold_unit": F.when(hit, F.col("u_")).otherwise(F.col("gold_unit")), "note": F.when(hit, "manual").otherwise(F.col("note"))}).drop("s_", "u_")


def reject(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Q16: items of these ids become rejected by hand."""
    found = items.join(ids.select("id").distinct().withColumn("hit_", F.lit(True)), "id", "left")
    return found.withColumns({"status": F.when(F.col("hit_"), "rejected").otherwise(F.col("status")), "note": F.when(F.col("hit_"), "manual").otherwise(F.col("note"))}).drop("hit_")


def item_stats(items: DataFrame) -> DataFrame:
    """Items by status; of confirmed ones not by hand how many agree with their prediction; of those by hand the accuracy in percent."""
    gold, pred = F.col("gold_subject"), F.col("pred_subject")
    auto = (F.col("status") == "confirmed") & (gold != "") & (F.col("note") != "manual")
    hand = (F.col("note") == "manual") & (gold != "") & (pred != "")
    return items.groupBy("status").agg(F.count("*").alias("n"), F.count_if(auto).alias("auto"), F.count_if(auto & (gold == pred)).alias("agree"), F.count_if(hand).alias("hand"), F.round(F.avg(F.when(hand, F.when(gold == pred, 100.0).otherwise(0.0))), 6).alias("accuracy"))


TELEMETRY = "pro_match double, anti_match double, competing double, rule_conflict string, raw_confidence string"


def training_rows(log: DataFrame) -> DataFrame:
    """Rows to learn from: resolved, with a label, classified. Telemetry is JSON: what is no object counts as empty, rows whose JSON is broken or whose confidence is no number
    are left out. The confidence before calibration counts, else the stored one; label 1 where the answer is the prediction."""
    text = F.nullif(F.trim(F.coalesce("telemetry", F.lit(""))), F.lit(""))
    kind = F.schema_of_variant(F.try_parse_json(text))
    kept = log.where("resolved AND trim(coalesce(gold_subject, '')) <> ''").where(F.coalesce("subject", F.lit("")) != R.UNCLASSIFIED).withColumns({"kind_": kind, "broken_": text.isNotNull() & F.try_parse_json(text).isNull(), "t_": F.from_json(text, TELEMETRY)})
    raw = F.coalesce(F.col("t_.raw_confidence"), F.col("confidence").cast("string"), F.lit("0"))
    number = lambda c: F.coalesce(F.when(F.startswith("kind_", F.lit("OBJECT")), F.col(f"t_.{c}")), F.lit(0.0))
    conflict = F.coalesce(F.when(F.startswith("kind_", F.lit("OBJECT")), ~F.col("t_.rule_conflict").isin("false", "0", "")), F.lit(False))
    own = F.when(F.startswith("kind_", F.lit("OBJECT")), raw).otherwise(F.coalesce(F.col("confidence").cast("string"), F.lit("0"))).try_cast("double")
    keep = [c for c in log.columns if c in (*KEY, "id", "doc_id")]
    return kept.where("NOT broken_").select(*keep, number("pro_match").alias("pro_match"), number("anti_match").alias("anti_match"), number("competing").alias("competing"), conflict.cast("int").alias("rule_conflict"), own.alias("confidence"), (F.col("gold_subject") == F.coalesce("subject", F.lit(""))).cast("int").alias("label")).where("confidence IS NOT NULL")


def seed(manifest: DataFrame, results: DataFrame, cap: int | None = None) -> DataFrame:
    """Results (source, page, num, ...) of the files of a manifest (source, gold_subject, first, last pages or null) within its pages, resolved with its label; with ``cap`` the first so
    many of each file, counted over ranges, so that no task has all of a file."""
    rows = results.join(manifest.select("source", F.col("gold_subject").alias("gold_"), "first", "last"), "source").where("page BETWEEN coalesce(first, page) AND coalesce(last, page)")
    if cap is not None:
        rows = prefix.ranged(rows, ["source"], ["page", "num"]).running(r_=("sum", F.lit(1), True)).rows.where(F.col("r_") <= cap).drop("r_")
    return rows.withColumns({"resolved": F.lit(True), "gold_subject": F.col("gold_")}).drop("gold_", "first", "last")


def first_of_each(rows: DataFrame, by: str, order: str, low: int, high: int, most: int) -> DataFrame:
    """Rows between two bounds of ``order``, inclusive, the first few of each."""
    kept = rows.where(F.col(order).between(low, high))
    return kept.withColumn("r_", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("r_") <= most).drop("r_")


def split_by_cache(requests: DataFrame, cache: DataFrame, by: str, key: str = "key") -> DataFrame:
    """How many requests of each group the cache answers, and how many not."""
    found = requests.join(cache.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    return found.groupBy(by).agg(F.count_if(F.col("hit").isNotNull()).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))

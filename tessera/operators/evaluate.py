"""Accuracy and overlap."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators import prefix
from tessera.sources import discard, written


def score(df: DataFrame, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """Rows need gold_subject, gold_sub, pred_subject, pred_sub, confidence; means of nothing are null."""
    right = F.col("gold_subject") == F.col("pred_subject")
    has = F.col("gold_sub").isNotNull() & (F.col("gold_sub") != "")
    rounded = lambda c, name: F.round(c, 6).alias(name)
    aggs = [
        F.count("*").alias("n"),
        rounded(F.avg(F.when(right, 1.0).otherwise(0.0)), "subject_acc"),
        F.count_if(has).alias("sub_n"),
        rounded(F.avg(F.when(has, F.when(right & (F.col("gold_sub") == F.col("pred_sub")), 1.0).otherwise(0.0))), "sub_acc"),
        rounded(F.avg(F.when(right, F.col("confidence"))), "conf_right"),
        rounded(F.avg(F.when(~right, F.col("confidence"))), "conf_wrong"),
    ]
    if not by:
        return df.agg(*aggs)
    return (df.rollup(*by) if rollup else df.groupBy(*by)).agg(*aggs)


def bag(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Order-free overlap of the characters of two texts: recall, precision and F1. Counts are taken before anything is joined."""

    def chars(c: str):
        return pairs.select(key, F.explode(F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", ""), "")).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count("*").alias(f"n_{c}"))

    both = chars(a).join(chars(b), [key, "ch"], "full_outer")
    out = both.groupBy(key).agg(F.sum(F.least(F.coalesce(f"n_{a}", F.lit(0)), F.coalesce(f"n_{b}", F.lit(0)))).alias("common"), F.sum(F.coalesce(f"n_{a}", F.lit(0))).alias("truth"), F.sum(F.coalesce(f"n_{b}", F.lit(0))).alias("given"))
    recall, precision = F.col("common") / F.nullif(F.col("truth"), F.lit(0)), F.col("common") / F.nullif(F.col("given"), F.lit(0))
    return out.select(key, "common", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(2 * F.col("common") / F.nullif(F.col("truth") + F.col("given"), F.lit(0)), 6).alias("f1"))


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp; Spark has no function for it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def grid(pairs: DataFrame, metrics: DataFrame, by: list[str], key: str) -> DataFrame:
    """Means of the overlap of recognised and true texts (``bag``) over each setting of a grid, with the number of samples and the characters in common. A mean leaves out the samples
    that have no such figure."""
    rows = pairs.select(key, *by).join(metrics, key, "left")
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), mean("recall"), mean("precision"), mean("f1"), F.coalesce(F.sum("common"), F.lit(0)).alias("common"))


def byte_windows(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Each byte (y, two hex digits) with the ``size`` before it (ctx, hex). A row carries its window alone, not the text."""
    raw = F.regexp_extract_all(F.hex(F.encode(F.col(text), "utf-8")), F.lit("(..)"))
    one = lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("raw_", i - size + 1, size), "").alias("ctx"), F.get(F.col("raw_"), i).alias("y"))
    flat = df.where(F.octet_length(text) > size).select(key, raw.alias("raw_"))
    return flat.select(key, F.explode(F.transform(F.sequence(F.lit(size), F.size("raw_") - 1), one)).alias("w")).select(key, "w.*")


def _counting(size: int):
    """Map (held, raw) to (held, code, n): how often each window of ``size`` + 1 bytes, as a number, comes in a batch."""

    def run(batches):
        for batch in batches:
            for held in (False, True):
                raw = batch.filter(pc.equal(batch.column("held"), held)).column("raw")
                lens = np.array(pc.binary_length(raw), dtype=np.int64)
                data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
                if len(data) <= size:
                    continue
                code = np.zeros(len(data) - size, np.int64)
                for i in range(size + 1):
                    code = (code << 8) | data[i : len(data) - size + i]
                # A window that would go on in the next text is none.
                text = np.repeat(np.arange(len(lens)), lens)
                codes, n = np.unique(code[text[: len(code)] == text[size:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), held)), pa.array(codes), pa.array(n.astype(np.int64))], ["held", "code", "n"])

    return run


def byte_counts(df: DataFrame, text: str, size: int, held: Column | None = None) -> DataFrame:
    """How often each byte (y) comes after each ``size`` bytes (ctx), at most five, in rows that are ``held`` and others (those of which neither holds are left out), as ``byte_windows`` counted; counted by batch before anything is
    moved."""
    rows = df.where(F.octet_length(text) > size).select((F.lit(False) if held is None else held).alias("held"), F.encode(text, "utf-8").alias("raw")).where("held IS NOT NULL")
    counts = rows.mapInArrow(_counting(size), "held boolean, code long, n long").groupBy("held", "code").agg(F.sum("n").alias("n"))
    form = F.lpad(F.hex("code"), 2 * size + 2, "0")
    return counts.select("held", F.substring(form, 1, 2 * size).alias("ctx"), F.substring(form, 2 * size + 1, 2).alias("y"), "n")


def bits_per_byte(windows: DataFrame, held: Column) -> DataFrame:
    """Mean bits of the held windows' bytes under add-one counts of the others. Windows are counted before anything is joined."""
    return bits_of_counts(windows.withColumn("held", held).where("held IS NOT NULL").groupBy("ctx", "y", "held").agg(F.count("*").alias("n")))


def bits_of_counts(counts: DataFrame) -> DataFrame:
    """As ``bits_per_byte``, of counted windows (ctx, y, held, n)."""
    own = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    pairs = counts.groupBy("ctx", "y").agg(own(~F.col("held")).alias("n2"), own(F.col("held")).alias("held"))
    met = pairs.groupBy("ctx").agg(F.sum("n2").alias("n1"))
    p = (F.col("n2") + 1) / (F.col("n1") + 256)
    out = pairs.where("held > 0").join(met, "ctx").agg(F.sum("held").alias("n"), F.sum(-F.log(p) * F.col("held")).alias("nats"))
    return out.select(F.round(F.col("nats") / F.col("n") / F.log(F.lit(2.0)), 6).alias("bits_per_byte"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def some(windows: DataFrame, n: int, seed: int, key: str, pos: str = "pos") -> DataFrame:
    """A batch of ``n`` windows, those of least hash under a seed; the same whenever it is drawn."""
    return windows.orderBy(F.xxhash64(F.lit(seed), key, pos), key, pos).limit(n)


# Knobs of an experiment, how a step changes one, and its bounds.
KNOBS = {
    "context_len": ("add", (-1, 1), 1, 8), "hidden": ("times", (0.5, 2.0), 8, 256), "emb_dim": ("times", (0.5, 2.0), 4, 64), "lr": ("times", (0.5, 2.0), 0.001, 4.0),
    "batch_size": ("times", (0.5, 2.0), 8, 256), "momentum": ("add", (-0.2, 0.05), 0.0, 0.98), "warmup_frac": ("add", (-0.05, 0.05), 0.0, 0.5), "n_layers": ("add", (-1, 1), 1, 3),
    "weight_decay": ("times", (0.1, 10.0), 0.0, 0.01), "residual": ("flip",), "layernorm": ("flip",), "optimizer": ("other", ("adam", "sgd")),
}
#: What a weight decay of 0 becomes, and the rate that goes with an optimizer.
FIRST_DECAY, RATES = 1e-4, {"adam": 0.01, "sgd": 0.2}


def steps(name: str, knob: tuple) -> list[dict[str, Column]]:
    """What each step of a knob sets."""
    old, how = F.col(name), knob[0]
    if how == "flip":
        return [{name: ~old}]
    if how == "other":
        one, two = knob[1]
        new = F.when(old == one, two).otherwise(one)
        return [{name: new, "lr": F.when(new == one, RATES[one]).otherwise(RATES[two])}]
    _, by, low, high = knob
    moved = [old + x if how == "add" else old * x for x in by]
    if name == "weight_decay":
        moved = [F.when(old == 0, FIRST_DECAY).otherwise(m) for m in moved]
    return [{name: F.greatest(F.lit(low), F.least(F.lit(high), m))} for m in moved]


def neighbours(configs: DataFrame, knobs: dict = KNOBS) -> DataFrame:
    """Every configuration one step away from each given one, within bounds, as knob and configuration; steps that change nothing are none. A change of optimizer brings its rate."""
    rows = []
    for name, knob in knobs.items():
        for new in steps(name, knob):
            fields = [(new[c] if c in new else F.col(c)).cast(configs.schema[c].dataType).alias(c) for c in configs.columns]
            rows.append(F.struct(F.lit(name).alias("knob"), *fields))
    flat = configs.withColumn("n_", F.explode(F.array(*rows)))
    changed = F.lit(False)
    for name in knobs:
        changed = changed | ((F.col("n_.knob") == name) & (F.col(f"n_.{name}") != F.col(name)))
    return flat.where(changed).select("n_.*").distinct()


def ledger(rounds: DataFrame, by: list[str], order: str = "round", value: str = "bpb") -> DataFrame:
    """One row for each experiment with what was best before it and whether it was kept."""
    return prefix.best_so_far(rounds, by, order, value).select(*by, order, value, "best", F.when(F.col("kept"), "KEEP").otherwise("DROP").alias("verdict"))


def fold_models(rows: DataFrame, features: list[str], label: str = "label", folds: int = 5, key: str = "doc_id", rounds: int = 100, tol: float = 1e-11) -> dict[int, dict]:
    """The calibration (A14) fitted without each fold in turn, all of them at once: a round of Newton's method for every fold is one aggregation by fold of the sums (gradient, upper half of the
    curvature, loss) over the rows outside it. Folds are by a hash of the key; those that leave fewer than ten rows or one class have no model."""
    # Written, as every round reads them.
    rows = written(rows.select(F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.lit(1.0).alias(f"x{len(features)}")))
    seen = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    sizes = {k: [sum(n for (f, y), n in seen.items() if f != k and y == v) for v in (0.0, 1.0)] for k in range(folds)}
    d = len(features) + 1
    beta = {k: np.zeros(d) for k, (none, one) in sizes.items() if none and one and none + one >= 10}
    best: dict[int, tuple[float, np.ndarray]] = {}
    open_ = set(beta)
    x, own = [F.col(f"x{i}") for i in range(d)], [F.col(f"b{i}") for i in range(d)]
    z = sum((b * c for b, c in zip(own, x, strict=True)), F.lit(0.0))
    p, w = 1 / (1 + F.exp(-z)), F.when(F.col("y") == 1, F.col("one")).otherwise(F.col("none"))
    side = F.when(F.col("y") == 1, z).otherwise(-z)
    sums = [F.sum(w * (F.greatest(-side, F.lit(0.0)) + F.log1p(F.exp(-F.abs(side))))).alias("loss")]  # log(1 + exp(-side)) without overflow
    sums += [F.sum(w * (p - F.col("y")) * x[i]).alias(f"g{i}") for i in range(d)]
    sums += [F.sum(w * p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
    kind = ", ".join(["k int", *(f"b{i} double" for i in range(d)), "none double", "one double"])
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("k <> fold")
    for _ in range(rounds):
        if not open_:
            break
        # A row a fold, so the plan is the same in every round.
        given = [(k, *map(float, beta[k]), sum(sizes[k]) / (2 * sizes[k][0]), sum(sizes[k]) / (2 * sizes[k][1])) for k in sorted(open_)]
        found = {r.k: r for r in each.join(F.broadcast(rows.sparkSession.createDataFrame(given, kind)), "k").groupBy("k").agg(*sums).collect()}
        for k, at in found.items():
            penalty = np.append(np.ones(d - 1), 0.0)
            loss = at.loss + 0.5 * float(penalty @ beta[k] ** 2)
            if k in best and loss > best[k][0] * (1 + 1e-12) + 1e-12:  # too long a step
                beta[k] = (beta[k] + best[k][1]) / 2
                continue
            best[k] = (loss, beta[k])
            curve = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    curve[i, j] = curve[j, i] = at[f"h{i}_{j}"]
            slope = np.array([at[f"g{i}"] for i in range(d)]) + penalty * beta[k]
            step = np.linalg.lstsq(curve + np.diag(penalty), slope, rcond=None)[0]
            beta[k] = beta[k] - step
            if np.abs(step).max() <= tol * max(1.0, np.abs(beta[k]).max()):
                open_.discard(k)
    discard(rows)
    return {k: {"coefficients": dict(zip(features, map(float, b[:-1]), strict=True)), "intercept": float(b[-1]), "n_samples": sum(sizes[k])} for k, b in beta.items()}


def cross_validated(rows: DataFrame, features: list[str], label: str = "label", folds: int = 5, key: str = "doc_id") -> DataFrame:
    """Accuracy of the calibration on each fold, fitted on the others; folds without a model or rows are left out."""
    rows = written(rows.select(key, label, *features))
    models = fold_models(rows, features, label, folds, key)
    z = F.lit(None).cast("double")
    for k, m in models.items():
        own = sum((F.lit(c) * F.col(name) for name, c in m["coefficients"].items()), F.lit(m["intercept"]))
        z = F.when(F.col("fold") == k, own).otherwise(z)
    scored = rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")).withColumn("z_", z).where("z_ IS NOT NULL")
    return scored.groupBy("fold").agg(F.count("*").alias("n"), (F.count_if((F.col("z_") > 0) == (F.col(label) == 1)) / F.count("*")).alias("accuracy"))


def fit_calibration(rows: DataFrame, features: list[str], label: str = "label", least: int = 10):
    """Balanced logistic regression with the penalty 1 / (2 * sum of weights) per unit; null with too few rows or one class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    # Written, as counting and fitting both read them.
    rows = written(rows.select(label, *features))
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(sizes.values())
    if total < least or len(sizes) < 2:
        discard(rows)
        return None
    weight = F.when(F.col(label) == 1, total / (2 * sizes[1])).otherwise(total / (2 * sizes[0]))
    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows.withColumn("w", weight).withColumn(label, F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="x", labelCol=label, weightCol="w", standardization=False, regParam=1.0 / total, maxIter=1000, tol=1e-10).fit(data)
    discard(rows)
    return {"source": "gold", "coefficients": dict(zip(features, map(float, model.coefficients), strict=True)), "intercept": float(model.intercept), "n_samples": total}

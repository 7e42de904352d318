"""Evidence folded into a calibrated confidence, within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import text as T
from tessera.functions.scalars import learned_confidence
from tessera.operators import evidence


def fold(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """Needs subject, sub_subject, raw_confidence, evidence; adds the counts, the sets of targets and confidence.

    A fold of learned weights counts only if they came from reviewed labels (source gold).
    """
    subject, sub, raw = (F.col(c) for c in ("subject", "sub_subject", "raw_confidence"))
    is_global = lambda e: F.array_contains(e.targets, R.UNCLASSIFIED) | F.array_contains(e.targets, "All")
    names = F.array(subject, sub, T.norm(subject), T.norm(sub))
    hit = lambda e: F.exists(e.targets, lambda t: F.array_contains(F.col("names_"), t) | F.array_contains(F.col("names_"), T.norm(t)))
    judged = F.transform(F.filter("evidence", lambda e: F.size(e.targets) > 0), lambda e: F.struct(e.targets.alias("targets"), e.polarity.alias("polarity"), e.confidence.alias("confidence"), (F.when(e.source == "filename", 1.5).otherwise(1.0) * e.confidence).alias("s"), is_global(e).alias("everywhere"), hit(e).alias("hit")))
    given = df.columns
    df = evidence.once(df.withColumn("names_", names), "judged_", judged)
    pick = lambda test: F.filter("judged_", test)
    df = df.withColumns(
        {
            "pro_": pick(lambda e: ~e.everywhere & e.hit & (e.polarity == "pro")),
            "anti_": pick(lambda e: ~e.everywhere & e.hit & (e.polarity == "anti")),
            "rival_": pick(lambda e: ~e.everywhere & ~e.hit & (e.polarity == "pro") & (e.confidence >= 0.7)),
            "against_": pick(lambda e: ~e.everywhere & (e.polarity == "anti")),
            "all_": F.size(pick(lambda e: e.everywhere & (e.polarity == "anti"))),
        }
    )
    strength = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + e.s)
    targets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda e: e.targets))))
    unknown = subject == R.UNCLASSIFIED
    everywhere = F.col("all_")
    df = df.withColumns(
        {
            "pro_match": F.size("pro_") + F.when(unknown, everywhere).otherwise(0),
            "anti_match": F.size("anti_") + F.when(unknown, 0).otherwise(everywhere),
            "competing": F.size("rival_"),
            "pro_score": strength("pro_"),
            "anti_score": strength("anti_") + F.when(unknown, 0.0).otherwise(everywhere.cast("double")),
            "rival_score": strength("rival_"),
            "conflicting": F.array_sort(F.array_intersect(targets("pro_"), targets("against_"))),
            "alternatives": targets("rival_"),
        }
    ).drop("names_", "judged_", "pro_", "anti_", "rival_", "against_", "all_")
    conflict = (F.size("conflicting") > 0) | ((F.col("pro_match") > 0) & (F.col("anti_match") > 0))
    df = df.withColumn("rule_conflict", conflict)
    if weights and weights.get("source") == "gold" and isinstance(weights.get("coefficients"), dict) and "intercept" in weights:
        c = learned_confidence(F.col("pro_match"), F.col("anti_match"), F.col("competing"), F.col("rule_conflict"), raw, weights)
    else:
        c = plain(raw, F.col("pro_score"), F.col("anti_score"), F.col("rival_score"), F.col("rule_conflict"), sub)
    c = F.when(unknown, F.least(raw, F.lit(0.25))).otherwise(c)
    df = df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(0.99), c)))
    # A filter on a result would else be pushed through all of the above and repeat it many times.
    made = [x for x in df.columns if x not in given or x == "confidence"]
    rest = [F.col(x) for x in df.columns if x not in made]
    return evidence.once(df, "fold_", F.struct(*made)).select(*rest, "fold_.*")


def plain(raw: Column, pro: Column, anti: Column, rival: Column, conflict: Column, sub: Column) -> Column:
    weak = (sub == R.OTHER) & (pro < 1.0)
    cap = lambda x: F.least(x, F.lit(3.0))
    return raw + 0.05 * cap(pro) - 0.12 * cap(anti) - 0.08 * cap(rival) - F.when(conflict, 0.08).otherwise(0.0) - F.when(weak, 0.12).otherwise(0.0)

"""What is read often is computed once, and the quicker forms of the text functions say what the plain ones say."""

import re

from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import text as T
from tessera.operators import evidence
from tessera.plans import problems as catalogue

SF = "/root/testdata/sf0.001"


def test_a_filter_on_the_fold_does_not_repeat_the_scan(spark):
    for name in ("review_queue", "train_features", "classify_review"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("not_german") == 1, name


def test_quick_forms(spark):
    texts = [None, "", "the AND of", "the and", "theme and android of", "ſhould and Thiſ the " + "x" * 60, "the-and.of" + "y" * 60, "thé and of é" * 9, "Ⅲ x·y・z ⅱ", "é 가나 각 x", "a b̀c", "한글 the and for " + "가" * 30 + "a" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    latin, hangul = F.regexp_count("text", F.lit("[A-Za-z]")), F.regexp_count("text", F.lit("[가-힣]"))
    words = F.regexp_count("text", F.lit(r"(?U)\b(?i:" + "|".join(R.FUNCTION_WORDS) + r")\b"))
    plain = F.coalesce((latin >= 60) & (latin >= 5 * hangul) & (words >= 3), F.lit(False))
    base = F.lower(F.translate(F.coalesce("text", F.lit("")), T.ROMAN + T.DROPPED, T.DIGITS))
    rows = df.select(evidence.english(F.col("text")).alias("e"), plain.alias("p"), T.norm_base(F.col("text")).alias("n"), base.alias("b"), T.composed(F.col("text")).alias("c"), T.nfc("text").alias("d")).collect()
    assert all((r.e, r.n, r.c) == (r.p, r.b, r.d) for r in rows) and any(r.e for r in rows)
    assert re.search("Ⅲ", texts[8]) and rows[8].n == "3xyz2"

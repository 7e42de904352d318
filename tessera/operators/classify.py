"""The flagship plan: problems to labelled, calibrated, explained rows, and what of them goes to review.

The model that reads a problem is outside: a function from DataFrame to DataFrame that adds ``reply``, its JSON (``stub`` stands in for tests). All
else is one projection after another, so the plan has no shuffle but that of the model and of the snapshot upsert.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonfix, scalars
from tessera.functions import rules as R
from tessera.functions import text as T
from tessera.operators import confidence, evidence, labels

REPLY = "subject string, sub_subject string, grade string, unit string, topic string, difficulty string, difficulty_score string, confidence string"
#: Token budgets of the attempts to get a reply.
BUDGETS = (1024, 1536, 2048)
HEADS = ("text", "evidence", "rationale", "alternatives")


def taxonomy() -> str:
    """the subjects and their courses, a line each."""
    by: dict[str, list[str]] = {}
    for subject, name in R.COURSES:
        by.setdefault(subject, []).append(name)
    return "\n".join(["Subjects and courses:", *(f"- {s}: {' / '.join(c)}" for s, c in by.items())])


def prompt(text: Column, items: Column) -> Column:
    """taxonomy, the most confident evidence, the one course of the cover, the text (cleaned, 1500 characters), what to answer."""
    clean = F.substring(T.clean_prompt(F.coalesce(text, F.lit(""))), 1, 1500)
    seen = evidence.lines(items)
    one = labels.cover_single(items)
    return F.concat_ws(
        "\n\n",
        F.lit(taxonomy()),
        F.when(seen != "", F.concat(F.lit("Evidence:\n"), seen)),
        F.concat(F.lit("The cover names the course "), one.sub_subject),
        F.when(T.strip(clean) != "", F.concat(F.lit("Text:\n"), clean)),
        F.lit("Answer with one JSON object: subject, sub_subject, grade, unit, topic, difficulty, difficulty_score, confidence."),
    )


def first_good(replies: Column) -> Column:
    """Of the replies to growing budgets the first that is not blank; null without one."""
    return F.get(F.filter(replies, lambda r: T.strip(F.coalesce(r, F.lit(""))) != ""), F.lit(0))


def stub(problems: DataFrame) -> DataFrame:
    """A model that answers by the text alone, for tests: the subject whose name stands first in it."""
    found = F.regexp_extract(F.lower("text"), "(" + "|".join(s.lower() for s in R.SUBJECTS) + ")", 1)
    return problems.withColumn("reply", F.to_json(F.struct(F.initcap(found).alias("subject"), F.lit("").alias("sub_subject"), F.lit("0.8").alias("confidence"))))


def answers(df: DataFrame) -> DataFrame:
    """The reply, mended if need be, as label, raw_confidence and fields with defaults; ``problem`` tells what is wrong with it."""
    df = df.withColumn("json_", jsonfix.lenient(F.col("reply"))).withColumn("r_", F.from_json("json_.value", REPLY))
    given = lambda c, other: F.coalesce(F.nullif(T.strip(F.col(f"r_.{c}")), F.lit("")), F.lit(other)).alias(c)
    bad = F.when(F.col("reply").isNull() | (F.col("json_.status") == "error"), "model_unparseable").when(F.col("r_").isNull(), "postprocess_error")
    return df.withColumns(
        {
            "problem": bad,
            "label": labels.reconcile(F.col("r_.subject"), F.col("r_.sub_subject")),
            "raw_confidence": scalars.norm_confidence(F.col("r_.confidence")),
            "fields": F.struct(given("grade", R.OTHER), given("unit", R.OTHER), given("topic", R.OTHER), given("difficulty", "medium"), scalars.clamp_score(F.col("r_.difficulty_score")).alias("difficulty_score")),
        }
    ).drop("json_", "r_")


def classify(problems: DataFrame, rules: DataFrame | None = None, weights: dict | None = None, model: Callable[[DataFrame], DataFrame] = stub, force: bool = False) -> DataFrame:
    """problems: source, page, num, text, cover, and any further columns. Adds evidence, subject, sub_subject, the fields of the reply, the counts of the fold, confidence, rationale,
    alternatives, needs_review, review_reason and solution.

    L10: a document whose name or cover (all its rows carry it) marks an answer book is not classified (unclassified at confidence 1, never in review) unless ``force``. L09: a
    row whose reply is missing or beyond repair is kept, unclassified at 0, with its reason. L07: priors by name, cover and language come before the confidence.
    """
    book = F.lit(False) if force else evidence.is_solution(T.composed(F.col("source")), T.composed(F.col("cover")))
    df = evidence.pre_classify(problems.withColumn("solution", book), "text", "source", "cover", rules)
    df = answers(model(df))
    judged = labels.priors(F.col("label"), F.col("evidence"), labels.cover_single(F.col("evidence")))
    fold = confidence.fold(df.withColumn("judged", judged).withColumns({"subject": F.col("judged.subject"), "sub_subject": F.col("judged.sub_subject")}).drop("judged", "label"), weights)
    why = labels.rationale(*[F.col(c) for c in ("subject", "confidence", "pro_match", "anti_match", "competing", "alternatives", "rule_conflict")])
    fold = fold.withColumn("rationale", why)
    out_of = F.col("solution") | F.col("problem").isNotNull()
    kept = lambda c, other: F.when(out_of, other).otherwise(F.col(c))
    zero = F.lit(0)
    fold = fold.withColumns(
        {
            "subject": kept("subject", F.lit(R.UNCLASSIFIED)),
            "sub_subject": kept("sub_subject", F.lit(R.OTHER)),
            "confidence": F.when(F.col("solution"), 1.0).when(F.col("problem").isNotNull(), 0.0).otherwise(F.col("confidence")),
            "rationale": F.when(F.col("solution"), "answer book, not classified").when(F.col("problem").isNotNull(), F.concat(F.lit("set aside: "), "problem")).otherwise(F.col("rationale")),
            "evidence": kept("evidence", F.array().cast(f"array<{evidence.ITEM}>")),
            "alternatives": kept("alternatives", F.array().cast("array<string>")),
            "pro_match": kept("pro_match", zero), "anti_match": kept("anti_match", zero), "competing": kept("competing", zero), "rule_conflict": kept("rule_conflict", F.lit(False)),
            "needs_review": ~F.col("solution") & F.col("problem").isNotNull(),
            "review_reason": F.when(~F.col("solution"), F.col("problem")),
        }
    ).drop("problem", "reply", "conflicting", "pro_score", "anti_score", "rival_score")
    # Rows are drawn from an array of one: a filter on a result would else be pushed through all of the above and repeat it many times.
    return fold.select(F.explode_outer(F.array(F.struct(*fold.columns))).alias("row")).select("row.*")


def for_review(results: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows that a person should see, with reason. Answer books are none."""
    why = F.when(~F.col("solution"), labels.flag(F.col("needs_review"), F.col("review_reason"), F.col("subject"), F.col("confidence"), limit))
    return results.select("*", F.explode_outer(F.array(why)).alias("reason")).where("reason IS NOT NULL")


def review_counts(results: DataFrame, limit: float = 0.5) -> DataFrame:
    """Total and rows that need review, by source."""
    why = labels.flag(F.col("needs_review"), F.col("review_reason"), F.col("subject"), F.col("confidence"), limit)
    return results.groupBy("source").agg(F.count("*").alias("total"), F.count_if(why.isNotNull()).alias("flagged"))


def progress(results: DataFrame) -> DataFrame:
    """The rows without their heavy columns."""
    return results.drop(*HEADS)


def report(results: DataFrame) -> DataFrame:
    """Rows and mean confidence by course, most frequent first."""
    return results.groupBy("sub_subject").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).orderBy(F.desc("n"), "sub_subject")


def band(c: Column) -> Column:
    """Words for a confidence."""
    return F.when(c >= 0.9, "very high").when(c >= 0.7, "high").when(c >= 0.5, "medium").otherwise("low")


def markdown_line(line: Column) -> Column:
    """A line of recognised text as Markdown: problem heads, choices, lines that speak of figures."""
    s = T.strip(line)
    return (
        F.when(F.rlike(s, F.lit(r"^\d{1,2}[.)]")), F.concat(F.lit("### "), s))
        .when(F.rlike(s, F.lit("^[①②③④⑤]")), F.concat(F.lit("- "), s))
        .when(F.rlike(s, F.lit(r"(?i)\b(graph|figure|table|chart)\b")), F.concat(F.lit("> **"), s, F.lit("**")))
        .otherwise(s)
    )

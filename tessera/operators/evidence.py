"""Evidence: rules, covers, languages, depth and file names against texts, without a shuffle.

An item of evidence is (keyword, polarity, targets, confidence, source, authoritative); the items of a row are an array in the order of their stages.
Rules are data: the default vocabulary is a literal array, and so is a short table of rules (``prepared``); a long one meets the texts through an index of grams (``gramindex``).
Adding a row adds a detector.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import text as T
from tessera.operators import gramindex
from tessera.sources import written

RULE = "struct<rank:int,scan:string,keyword:string,key:string,polarity:string,targets:array<string>,confidence:double,source:string,guard:boolean>"
FIELDS = ("rank", "scan", "keyword", "key", "polarity", "targets", "confidence", "source", "guard")
ITEM = "struct<keyword:string,polarity:string,targets:array<string>,confidence:double,source:string,authoritative:boolean>"
#: Rules of a table that stands in the plan as one literal; longer ones are joined.
LITERAL_RULES = 1_000


def item(keyword: Column, polarity: str, targets: Column, confidence: Column, source: str, authoritative: bool = False) -> Column:
    return F.struct(
        keyword.alias("keyword"), F.lit(polarity).alias("polarity"), targets.alias("targets"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), F.lit(authoritative).alias("authoritative")
    )


def default_rules() -> Column:
    """The rules of the vocabulary, F04: with their normalised keywords."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"), F.lit(s).alias("scan"), F.lit(k).alias("keyword"), T.norm(F.lit(k)).alias("key"), F.lit(p).alias("polarity"), F.array(*map(F.lit, t)).alias("targets"),
                F.lit(float(c)).alias("confidence"), F.lit(src).alias("source"), F.lit(g).alias("guard"),
            )
            for i, s, k, p, t, c, src, g in R.rule_rows()
        ]
    )


def prepared(rules: DataFrame) -> DataFrame:
    """A table of rules (scan, keyword, polarity, targets, confidence, source, guard, and rank, the place of the scan) with the normalised
    keyword; of a scan's keywords that are equal so the first by keyword stays, empty ones go. Ranks follow (rank, key, keyword)."""
    keyed = rules.withColumn("key", T.norm(T.composed(F.col("keyword")))).where("key <> ''")
    rest = ("keyword", "polarity", "targets", "confidence", "source", "guard")
    first = keyed.groupBy("rank", "scan", "key").agg(F.min_by(F.struct(*rest), "keyword").alias("r"))
    return first.select("rank", "scan", "key", "r.*")


def table_rules(rules: DataFrame) -> Column | None:
    """The rules of a prepared table as one array; null for one of over LITERAL_RULES rows."""
    rows = rules.select(*FIELDS).limit(LITERAL_RULES + 1).collect()
    if len(rows) > LITERAL_RULES:
        return None
    rows = sorted((r.asDict() for r in rows), key=lambda r: (r["rank"], r["key"], r["keyword"]))
    return F.from_json(F.lit(json.dumps(rows)), f"array<{RULE}>")


def let(value: Column, body) -> Column:
    """body(value), the value computed once for a row: the optimizer would else copy it into every lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once for a row, however often it is read: drawn through an outer explode, which the optimizer neither copies into what reads it nor pushes a filter through."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def normalised(df: DataFrame, text: Column, name: str) -> DataFrame:
    """F02 of a composed text as a column, each of its steps gone through once a row."""
    return once(once(df, "base_", T.norm_base(text)), name, T.norm_end(F.col("base_"))).drop("base_")


def hits(text: Column, rules: Column | None = None) -> Column:
    """The rules whose key a normalised text contains, in order; guarded keys of one or two characters must end a word."""
    allowed = lambda tn, r: ~r.guard | (F.length(r["key"]) > 2) | T.ends_word(tn, r["key"])
    return let(text, lambda tn: F.filter(default_rules() if rules is None else rules, lambda r: F.contains(tn, r["key"]) & allowed(tn, r)))


def numbered(df: DataFrame) -> DataFrame:
    """Rows numbered (``uid_``) and written, for ``indexed``; texts are most of them, so they are pressed harder."""
    return written(df.withColumn("uid_", F.monotonically_increasing_id()), "zstd")


def constants(rules: DataFrame) -> dict[str, Column]:
    """Fields that are the same, and not null, in all rules, with their value."""
    names = ("polarity", "targets", "confidence", "source", "guard")
    all_ = rules.agg(*[x for f in names for x in (((F.min(f) == F.max(f)) & (F.count(f) == F.count("*"))).alias(f), F.min(f).alias(f"{f}_"))]).first()
    return {f: F.lit(all_[f"{f}_"]).cast(rules.schema[f].dataType) for f in names if all_[f]}


def indexed(df: DataFrame, text: Column | str, rules: DataFrame, name: str) -> DataFrame:
    """As ``hits``, for any number of rules and texts. Rows are numbered and written with their normalised text (``text``, or the column of that name), unless they are already (``numbered``), the rules
    that an index gives for a row are brought together, and the row, joined with them once, decides which of them it holds. A rule is moved for each row it may be in, so what all rules have in common stays behind,
    and so does a keyword that is its key."""
    rows, own = (df, text) if isinstance(text, str) else (df.withColumn("tn_", text), "tn_")
    rows = rows if "uid_" in rows.columns else numbered(rows)
    rules = written(rules.select(*FIELDS))
    same = constants(rules)
    apart = [f for f in FIELDS if f not in ("rank", "key", "keyword", *same)]
    slim = rules.select("rank", "key", F.when(F.col("keyword").eqNullSafe(F.col("key")), None).otherwise(F.struct("keyword")).alias("other"), *apart)
    met = gramindex.candidates(rows.select(F.col("uid_").alias("uid"), F.col(own).alias("text")), slim)
    wide = lambda x: F.struct(x["rank"], x["key"].alias("key"), F.when(x.other.isNull(), x["key"]).otherwise(x.other.keyword).alias("keyword"), *[x[f].alias(f) for f in apart])
    # In order of their first fields; one that a long text has met in several parts stands next to itself.
    per = met.groupBy(F.col("uid").alias("uid_")).agg(F.array_sort(F.transform(F.collect_list(F.struct(*slim.columns)), wide)).alias("met_"))
    tn = F.col(own)
    of = lambda x, f: same[f] if f in same else x[f]
    fresh = lambda x, i: (i == 0) | (x != F.get(F.col("met_"), i - 1))
    held = F.filter("met_", lambda x, i: F.contains(tn, x["key"]) & fresh(x, i) & (~of(x, "guard") | (F.length(x["key"]) > 2) | T.ends_word(tn, x["key"])))
    hits_ = F.transform(held, lambda x: F.struct(*[of(x, f).alias(f) for f in FIELDS]))
    # Once a row: a filter on the hits, and each column made of them, would else look for all keys again.
    out = once(rows.join(per, "uid_", "left"), name, F.coalesce(hits_, F.array().cast(f"array<{RULE}>")))
    return out.drop("uid_", "met_", *([] if isinstance(text, str) else ["tn_"]))


def with_hits(df: DataFrame, text: Column, rules: DataFrame | None, name: str) -> DataFrame:
    """``hits`` of a composed text, normalised, as a column; rules as in ``scan``."""
    few = None if rules is None else table_rules(rules)
    if rules is not None and few is None:
        return indexed(normalised(df, text, "norm_"), "norm_", rules, name).drop("norm_")
    return once(normalised(df, text, "tn_"), name, hits(F.col("tn_"), few)).drop("tn_")


def scan(df: DataFrame, text: str = "text", rules: DataFrame | None = None) -> DataFrame:
    """The hits of each row's text as ``evidence``. rules: a prepared table of any length; without one the default vocabulary."""
    return with_hits(df, T.composed(F.col(text)), rules, "evidence")


def top(evidence: Column, k: int = 12) -> Column:
    """Of keywords equal when normalised the first, then the k most confident, ties in order."""

    def best(all_: Column) -> Column:
        keys = F.transform(all_, lambda e: T.norm(e.keyword))

        def first(names: Column) -> Column:
            order = F.filter(F.transform(all_, lambda e, i: F.struct((-e.confidence).alias("c"), i.alias("i"), e.alias("e"))), lambda x: (F.array_position(names, F.element_at(names, x.i + 1)) == x.i + 1) & (F.element_at(names, x.i + 1) != ""))
            return F.transform(F.slice(F.array_sort(order), 1, k), lambda x: x.e)

        return let(keys, first)

    return let(evidence, best)


def line(e: Column) -> Column:
    sign = F.when(e.polarity == "pro", "+").when(e.polarity == "anti", "-").otherwise("~")
    to = F.when(F.size(e.targets) > 0, F.concat(F.lit(" -> "), F.array_join(F.slice(e.targets, 1, 3), "/"))).otherwise("")
    return F.concat(F.lit("- "), e.keyword, F.lit(" (weight:"), F.format_string("%.2f", e.confidence), F.lit(") ["), e.source, F.lit("/"), sign, F.lit("]"), to)


def lines(evidence: Column, k: int = 12) -> Column:
    return F.array_join(F.transform(top(evidence, k), line), "\n")


def english(text: Column) -> Column:
    """Latin letters by far, and function words of English."""
    latin, hangul = F.length(F.regexp_replace(text, "[^A-Za-z]+", "")), F.length(text) - F.length(F.regexp_replace(text, "[가-힣]+", ""))
    # Three words one after the other, each the first that follows: the groups are atomic, so a text is gone through once, and no further than the third word.
    words = F.rlike(text, F.lit(r"(?sU)\A(?>.*?\b(?i:" + "|".join(R.FUNCTION_WORDS) + r")\b){3}"))
    return F.coalesce((latin >= F.greatest(F.lit(60), 5 * hangul)) & words, F.lit(False))


def english_items(text: Column) -> Column:
    one = F.array(item(F.lit("mostly English"), "pro", F.array(F.lit("English")), F.lit(0.9), "context"))
    return F.when(english(text), one).otherwise(F.array().cast(f"array<{ITEM}>"))


def depth(text: Column, marks: str = r"[=+*/^<>%$#&]", high: str = r"(?i)prove|derive|show that", low: str = r"(?i)choose|select|find") -> Column:
    """signals of difficulty, an array of (signal, value, confidence)."""
    counts = F.struct(F.length(text).alias("n"), F.regexp_count(text, F.lit(marks)).alias("found"), (F.length(text) - F.length(F.regexp_replace(text, "[a-z]{5,}", ""))).alias("long"))
    return let(counts, lambda c: _signals(text, c.n, c.found, c.long / c.n, high, low))


def _signals(text: Column, n: Column, found: Column, words: Column, high: str, low: str) -> Column:
    per = found / F.greatest(n, F.lit(1)) * 1000
    one = lambda name, value, c: F.struct(F.lit(name).alias("signal"), F.round(value.cast("double"), 6).alias("value"), F.round(c.cast("double"), 6).alias("confidence"))
    made = F.array(
        F.when(found >= 3, one("dense", per, F.least(0.5 + per * 0.05, F.lit(0.9)))).when((found == 0) & (n > 200), one("absent", F.lit(0), F.lit(0.5))),
        F.when(F.rlike(text, F.lit(high)), one("high", F.lit(1), F.lit(0.65))).when(F.rlike(text, F.lit(low)), one("low", F.lit(1), F.lit(0.4))),
        F.when(F.rlike(text, F.lit(r"(?i)\[[34] points\]|<\s*notes\s*>")), one("marked", F.lit(1), F.lit(0.6))),
        F.when((n > 100) & (words > 0.55), one("terms", words, F.lit(0.5))),
    )
    return F.when(n >= 20, F.filter(made, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<signal:string,value:double,confidence:double>>"))


def depth_items(text: Column) -> Column:
    """F09 as evidence: only the lack of formulas speaks against courses, the other signals name none."""
    against, none = F.array(*map(F.lit, R.FORMULA_COURSES)), F.array().cast("array<string>")
    made = lambda d: F.struct(
        d.signal.alias("keyword"), F.when(d.signal == "absent", "anti").otherwise("neutral").alias("polarity"), F.when(d.signal == "absent", against).otherwise(none).alias("targets"),
        d.confidence.alias("confidence"), F.lit("depth").alias("source"), F.lit(False).alias("authoritative"),
    )
    return F.transform(depth(F.coalesce(text, F.lit(""))), made)


def first_rule(name: Column, rules: list[tuple[str, str, float]]) -> Column:
    """the first rule (not the longest) whose key the name contains."""
    out = F.when(F.contains(name, F.lit(rules[0][0])), F.struct(F.lit(rules[0][1]).alias("target"), F.lit(rules[0][2]).alias("confidence")))
    for key, target, c in rules[1:]:
        out = out.when(F.contains(name, F.lit(key)), F.struct(F.lit(target).alias("target"), F.lit(c).alias("confidence")))
    return out


def stands_apart(name: Column, key: str) -> Column:
    """A key that is not inside a longer word of letters."""
    return F.rlike(name, F.lit(rf"(?<!\p{{L}})\Q{key}\E(?!\p{{L}})"))


def teacher_of(name: Column) -> Column:
    """the first teacher a normalised name holds, as (keyword, target, confidence): .85 with a course, .75 without. Names of one or two letters must stand
    apart, names that are also words never count."""
    out = F.lit(None).cast("struct<keyword:string,target:string,confidence:double>")
    for key, subject, course in reversed(R.NAME_TEACHERS):
        if key in R.NAME_AMBIGUOUS:
            continue
        met = F.contains(name, F.lit(key)) if len(key) > 2 else stands_apart(name, key)
        out = F.when(met, F.struct(F.lit(key).alias("keyword"), F.lit(course or subject).alias("target"), F.lit(0.85 if course else 0.75).alias("confidence"))).otherwise(out)
    return out


def name_items(name: Column) -> Column:
    """at most one item of a file name: a course's word (.90), else a teacher, else a subject's word (.80). The name is composed already."""
    low = F.lower(F.coalesce(name, F.lit("")))
    pick = lambda table, c: F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.struct(F.lit(k).alias("keyword"), F.lit(t).alias("target"), F.lit(c).alias("confidence"))) for k, t in table])
    found = F.coalesce(pick(R.NAME_COURSES, 0.9), teacher_of(T.norm(name)), pick(R.NAME_SUBJECTS, 0.8))
    return let(found, lambda f: F.when(f.isNull(), F.array().cast(f"array<{ITEM}>")).otherwise(F.array(item(f.keyword, "pro", F.array(f.target), f.confidence, "filename"))))


def holds_any(text: Column, words) -> Column:
    return F.rlike(text, F.lit("|".join(f"\\Q{w}\\E" for w in words)))


def is_solution(name: Column, cover: Column | None = None) -> Column:
    """Marks in the name, else in the cover (normalised both)."""
    found = holds_any(F.lower(name), R.SOLUTION_MARKS)
    if cover is not None:
        found = F.coalesce(found, F.lit(False)) | holds_any(T.norm(cover), [m.replace(" ", "") for m in R.SOLUTION_COVERS])
    return F.coalesce(found, F.lit(False))


def cover_items(cover: Column) -> Column:
    """F13/F14, in this order: the title area(course), authoritative (.95); courses (.92); aliases that no course found contains (.90); subjects, without the
    test's own name (.85); the notice of a listening test (.92); marks of books outside the curriculum, against everything (.70)."""
    from tessera.operators.labels import course

    listed = [name for _, name in R.COURSES]
    none = F.array().cast(f"array<{ITEM}>")

    def found(t: Column) -> Column:
        titled = course(F.regexp_extract(t, r"area[(（]([^)）]+)[)）]", 1))
        named = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), T.norm(F.lit(n)).alias("k")) for n in listed]), lambda x: F.contains(t, x.k))
        aliased = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n"), T.norm(F.lit(a)).alias("k")) for a, n in R.COURSE_ALIASES]), lambda x: F.contains(t, x.k) & ~F.exists(named, lambda m: F.contains(m.k, x.k)))
        bare = F.replace(t, T.norm(F.lit(R.BOILERPLATE)), F.lit(""))
        subjects = F.filter(F.array(*map(F.lit, R.SUBJECTS)), lambda s: F.contains(bare, T.norm(s)))
        outside = F.filter(F.array(*map(F.lit, R.OUTSIDE)), lambda w: F.contains(t, T.norm(w)))
        return F.concat(
            F.when(titled.isNull(), none).otherwise(F.array(item(titled.sub_subject, "pro", F.array(titled.sub_subject), F.lit(0.95), "cover", True))),
            F.transform(named, lambda x: item(x.n, "pro", F.array(x.n), F.lit(0.92), "cover")),
            F.transform(aliased, lambda x: item(x.a, "pro", F.array(x.n), F.lit(0.9), "cover")),
            F.transform(subjects, lambda s: item(s, "pro", F.array(s), F.lit(0.85), "cover")),
            F.when(F.contains(t, T.norm(F.lit(R.LISTENING))), F.array(item(F.lit("listening test"), "pro", F.array(F.lit("English")), F.lit(0.92), "cover"))).otherwise(none),
            F.transform(outside, lambda w: item(w, "anti", F.array(F.lit(R.UNCLASSIFIED)), F.lit(0.7), "context")),
        )

    return F.when(F.coalesce(cover, F.lit("")) == "", none).otherwise(let(T.norm(cover), found))


def as_items(rules: Column) -> Column:
    return F.transform(rules, lambda r: F.struct(r.keyword.alias("keyword"), r.polarity.alias("polarity"), r.targets.alias("targets"), r.confidence.alias("confidence"), r.source.alias("source"), F.lit(False).alias("authoritative")))


def pre_classify(df: DataFrame, text: str, name: str, cover: str, rules: DataFrame | None = None) -> DataFrame:
    """All evidence of a row, in order: cover, rules, English, depth, file name."""
    t, n, c = (T.composed(F.coalesce(F.col(x), F.lit(""))) for x in (text, name, cover))
    df = df.withColumns({"text_": t, "name_": n, "cover_": c})
    df = with_hits(df, F.col("text_"), rules, "found_")
    items = F.concat(cover_items(F.col("cover_")), as_items(F.col("found_")), english_items(F.col("text_")), depth_items(F.col("text_")), name_items(F.col("name_")))
    return once(df, "evidence", items).drop("text_", "name_", "cover_", "found_")


def cover(df: DataFrame, title: str, names: list[str], aliases: list[tuple[str, str]]) -> DataFrame:
    """F13 over any vocabulary: names in a title (.92), and aliases (.90) that no matched name contains."""
    t = T.norm(F.col(title))
    named = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(t, n))
    other = F.filter(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(n).alias("name")) for a, n in aliases]), lambda a: F.contains(t, a["alias"]) & ~F.exists(named, lambda n: F.contains(n, a["alias"])))
    found = F.concat(F.transform(named, lambda n: F.struct(n.alias("target"), F.lit(0.92).alias("confidence"))), F.transform(other, lambda a: F.struct(a["name"].alias("target"), F.lit(0.9).alias("confidence"))))
    targets = F.array_sort(F.array_distinct(F.transform(found, lambda f: f.target)))
    return df.withColumn("found", found).withColumn("single", F.when(F.size(targets) == 1, targets[0]))

"""Labels: reconciliation with the courses (L01, J05), priors (L02 to L06), rationale (L08), flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import text as T

PAIR = "struct<subject:string,sub_subject:string>"


def pair(subject: str, sub: str) -> Column:
    return F.struct(F.lit(subject).alias("subject"), F.lit(sub).alias("sub_subject"))


def course(raw: Column) -> Column:
    """Subject and course by the course's key, an alias's key before it; null if it is none."""
    key = T.course_key(raw)
    parent = {c: s for s, c in R.COURSES}
    out = F.lit(None).cast(PAIR)
    for name, of in [*((c, c) for _, c in R.COURSES), *R.COURSE_ALIASES]:
        out = F.when(key == T.course_key(F.lit(name)), pair(parent[of], of)).otherwise(out)
    return out


def course_of_alias(raw: Column) -> Column:
    out = F.lit(None).cast(PAIR)
    parent = {c: s for s, c in R.COURSES}
    for alias, name in reversed(R.COURSE_ALIASES):
        out = F.when(F.contains(raw, F.lit(alias)), pair(parent[name], name)).otherwise(out)
    return out


def subject_of(raw: Column) -> Column:
    out = F.when(raw.isin(*R.SUBJECTS), raw)
    for alias, name in reversed(R.SUBJECT_ALIASES):
        out = F.when(F.contains(F.lower(raw), F.lit(alias)), F.lit(name)).otherwise(out)
    return F.when(out.isNotNull(), F.struct(out.alias("subject"), F.lit(R.OTHER).alias("sub_subject")))


def reconcile(subject: Column, sub: Column) -> Column:
    """At each step the course field before the subject field; what nothing knows is unclassified."""
    subject, sub = (T.strip(F.coalesce(x, F.lit(""))) for x in (subject, sub))
    return F.coalesce(course(sub), course(subject), course_of_alias(sub), course_of_alias(subject), subject_of(subject), pair(R.UNCLASSIFIED, R.OTHER))


def cover_single(evidence: Column) -> Column:
    """The one course that evidence of the cover (.9 or more) names; if authoritative items name courses, theirs alone count. Null for none or several."""
    strong = F.filter(evidence, lambda e: (e.source == "cover") & (e.polarity == "pro") & (e.confidence >= 0.9))
    pairs = lambda items: F.array_distinct(F.filter(F.transform(F.flatten(F.transform(items, lambda e: e.targets)), course), lambda p: p.isNotNull()))
    titled, named = pairs(F.filter(strong, lambda e: e.authoritative)), pairs(strong)
    only = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))
    return F.when(F.size(titled) > 0, only(titled)).otherwise(only(named))


def name_prior(evidence: Column) -> Column:
    """The first course that evidence of the file name names; null without one."""
    named = F.filter(F.transform(F.flatten(F.transform(F.filter(evidence, lambda e: e.source == "filename"), lambda e: e.targets)), course), lambda p: p.isNotNull())
    return F.get(named, F.lit(0))


def is_english(evidence: Column) -> Column:
    """Evidence for English alone, at .9 or more."""
    return F.exists(evidence, lambda e: (e.polarity == "pro") & (e.targets == F.array(F.lit("English"))) & (e.confidence >= 0.9))


def priors(label: Column, evidence: Column, cover: Column) -> Column:
    """Name, then cover (a pair, null for none), then language. Only the last touches unclassified labels."""
    unknown = label.subject == R.UNCLASSIFIED
    known = F.coalesce(name_prior(evidence), cover, label)
    return F.when(unknown & is_english(evidence), pair("English", R.OTHER)).when(unknown, label).otherwise(known)


def rationale(subject: Column, confidence: Column, pro: Column, anti: Column, competing: Column, alternatives: Column, conflict: Column) -> Column:
    """One line; absent parts are skipped."""
    return F.concat_ws(
        " · ",
        F.concat(F.lit("confidence "), F.round(F.round(confidence, 6).cast("decimal(10,6)"), 2).cast("string")),
        F.when(subject == R.UNCLASSIFIED, "unclassified"),
        F.when(pro > 0, F.concat(F.lit("for "), pro.cast("string"))),
        F.when(anti > 0, F.concat(F.lit("against "), anti.cast("string"))),
        F.when((competing > 0) & (F.size(alternatives) > 0), F.concat(F.lit("rivals: "), F.array_join(F.slice(alternatives, 1, 3), ", "))).when(competing > 0, F.concat(F.lit("rivals "), competing.cast("string"))),
        F.when(conflict, "conflict"),
        F.when((pro == 0) & (anti == 0) & (competing == 0), "no evidence"),
    )


def flag(needs: Column, why: Column, subject: Column, confidence: Column, limit: float = 0.5) -> Column:
    """The first reason to review a row, null without one."""
    return F.when(F.coalesce(needs, F.lit(False)), F.coalesce(why, F.lit("needs_review"))).when(subject == R.UNCLASSIFIED, "unclassified").when(confidence < limit, "low_confidence")

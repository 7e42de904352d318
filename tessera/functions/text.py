"""Text functions on columns. Names of written forms follow SURVEY §2.5."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Roman numeral signs and their digits; the blank and the five middle dots that are dropped.
ROMAN, DIGITS = "ⅢⅡⅠⅲⅱⅰ", "321321"
DROPPED = " ·・･‧•"
#: Ranges of characters that canonical composition leaves as they are, and that combine with none of their like.
STABLE = r"\x00-\u02ff\u0400-\u0482\u048a-\u052f\u1e00-\u1e99\u2002-\u20cf\u2100-\u2102\u2190-\u2328\u2460-\u27ff\u3003-\u3029\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fff\uac00-\ud7a3\ue000-\uf8ff\uff01-\uffef"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(s: Column) -> Column:
    """Canonical composition. Only texts with a character that it might change go to the Arrow function; the others pass as null.
    The many ranges are slow to go through, so characters of the first are told by one comparison before."""
    return F.coalesce(nfc(F.when(F.rlike(s, F.lit(f"[[^\\x00-\\u02ff]&&[^{STABLE}]]")), s)), s)


def norm_base(s: Column) -> Column:
    """F01 of composed text: null is empty, numerals to digits before lower-casing, ASCII blanks and middle dots dropped. Texts without numerals and dots, nearly all, need no
    look-up of each character."""
    s = F.coalesce(s, F.lit(""))
    return F.lower(F.when(F.rlike(s, F.lit(f"[[^\\x00-\\x7f]&&[{ROMAN}{DROPPED[1:]}]]")), F.translate(s, ROMAN + DROPPED, DIGITS)).otherwise(F.replace(s, F.lit(" "), F.lit(""))))


def norm(s: Column) -> Column:
    """also i, ii, iii to digits between a Hangul syllable and anything but a Latin letter."""
    return norm_end(norm_base(s))


def norm_end(s: Column) -> Column:
    """F02 from F01 on."""
    out = s
    for form, digit in (("iii", "3"), ("ii", "2"), ("i", "1")):
        out = F.regexp_replace(out, f"(?<=[가-힣]){form}(?![a-z])", digit)
    return F.when(F.rlike(s, F.lit("[가-힣]i")), out).otherwise(s)


def course_key(s: Column) -> Column:
    """i, ii, iii to digits wherever they stand."""
    s = norm_base(s)
    for form, digit in (("iii", "3"), ("ii", "2"), ("i", "1")):
        s = F.replace(s, F.lit(form), F.lit(digit))
    return s


def quoted(kw: Column) -> Column:
    return F.concat(F.lit("\\Q"), kw, F.lit("\\E"))


def ends_word(text: Column, kw: Column) -> Column:
    """some occurrence of kw is not followed by a Hangul syllable."""
    return F.rlike(text, F.concat(quoted(kw), F.lit("(?![가-힣])")))


def stands_alone(text: Column, kw: Column) -> Column:
    """some occurrence has no Hangul syllable on either side."""
    return F.rlike(text, F.concat(F.lit("(?<![가-힣])"), quoted(kw), F.lit("(?![가-힣])")))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")


def clean_prompt(s: Column) -> Column:
    """private-use characters out, runs of blanks to one, three or more line ends to two."""
    s = F.regexp_replace(s, "[\ue000-\uf8ff]", "")
    return F.regexp_replace(F.regexp_replace(s, "[ \t]{2,}", " "), "\n{3,}", "\n\n")


def clean_transcription(s: Column) -> Column:
    """a run of private-use characters to one □, invisible ones out, runs of blanks to one; nothing but □ is empty."""
    s = F.regexp_replace(s, "[\ue000-\uf8ff]+", "□")
    s = F.regexp_replace(s, "[\ufffd\u200b\u200c\u200d\ufeff\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    s = strip(F.regexp_replace(s, "[ \t]{2,}", " "))
    return F.when(F.rlike(s, F.lit(r"\A[□ ]*\z")), F.lit("")).otherwise(s)


def clean_passage(s: Column, limit: int = 6000) -> Column:
    """F19."""
    s = F.regexp_replace(F.regexp_replace(s, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.substring(strip(s), 1, limit)


def sentences(s: Column) -> Column:
    """cut after . ! ? before white space; empty parts dropped."""
    return F.filter(F.split(s, r"(?U)(?<=[.!?])\s+"), lambda x: x != "")


def structured(paragraphs: Column) -> Column:
    """an empty paragraph before each numbered one but the first."""
    return F.flatten(F.transform(paragraphs, lambda x, i: F.when((i > 0) & F.rlike(x, F.lit(r"^\d{1,3}\.\s")), F.array(F.lit(""), x)).otherwise(F.array(x))))


def problem_number(line: Column) -> Column:
    """number at the head of a line, as 1. or 1), [1], 1번; null without one."""
    found = F.regexp_extract(line, r"^(?:(\d{1,2})[.)]|\[(\d{1,2})\]|(\d{1,2})번)", 0)
    return F.regexp_replace(F.nullif(found, F.lit("")), r"\D", "").cast("int")


def number_rest(line: Column) -> Column:
    """What follows the number at the head of a line."""
    return strip(F.regexp_replace(line, r"^(?:\d{1,2}[.)]|\[\d{1,2}\]|\d{1,2}번)", ""))


def read_number(word: Column) -> Column:
    """a word that is a number of one or two digits and a full stop, bracket or comma, as recognition gives it."""
    return F.nullif(F.regexp_extract(word, r"^(\d{1,2})[.),]$", 1), F.lit("")).cast("int")


def bare_number(word: Column) -> Column:
    """a word that is a number of two or three digits alone, 1 to 999."""
    n = F.nullif(F.regexp_extract(word, r"^(\d{2,3})$", 1), F.lit("")).cast("int")
    return F.when(n >= 1, n)


def set_range(line: Column) -> Column:
    """(s, e) of a heading like [3~5] at the head of a line; null if out of bounds."""
    p = r"^\s*\[\s*(\d{1,3})\s*[~～∼]\s*(\d{1,3})\s*\]"
    s, e = (F.nullif(F.regexp_extract(line, p, k), F.lit("")).cast("int") for k in (1, 2))
    return F.when((s >= 1) & (s < e) & (e <= 999) & (e - s <= 6), F.struct(s.alias("s"), e.alias("e")))


def xml_escape(s: Column) -> Column:
    """F24."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(raw), F.lit(name))
    return s


def without_space(s: Column) -> Column:
    """F29."""
    return F.regexp_replace(s, r"(?U)\s+", "")


# Roles of a phrase and their tags.
ROLES = (("S", "subject"), ("V", "verb"), ("O", "object"), ("C", "complement"), ("M", "modifier"), ("CONN", "conjunction"), ("PREP", "prepositional phrase"), ("", ""))


def role_tag(role: Column) -> Column:
    """[name] of a role, whatever its case; an unknown role stands for itself, no role for nothing."""
    names = F.create_map(*[F.lit(x) for pair in ROLES for x in pair])
    name = F.coalesce(F.element_at(names, F.upper(role)), role)
    return F.when(name != "", F.concat(F.lit("["), name, F.lit("]"))).otherwise("")


def repaired_name(name: Column, given: str = "cp437", meant: str = "euc-kr") -> Column:
    """A name whose bytes were read in one code page and meant in another; what cannot be so stays."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return x.encode(given).decode(meant) if x else x
            except UnicodeError:
                return x

        return s.map(one)

    return F.coalesce(run(F.when(F.rlike(name, F.lit(r"[^\x00-\x7f]")), name)), name)

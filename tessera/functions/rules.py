"""Rule and label vocabularies: data, not code. Small and our own, for Latin-script text, but for the function words, which are given."""

from __future__ import annotations

UNCLASSIFIED, OTHER = "Unclassified", "Other"

# Fixed values: (scan, keywords, polarity, targets, confidence, source, guard short keywords).
SCANS = (
    ("en_words", ("the", "with", "that"), "pro", ("English",), 0.8, "ocr", False),
    ("de_words", ("und", "lich", "keit"), "pro", ("German",), 0.75, "ocr", False),
    ("fr_words", ("eau", "elle", "pour"), "pro", ("French",), 0.6, "ocr", False),
    ("es_words", ("ción", "que", "mente"), "pro", ("Physics 2", "Science"), 0.9, "ocr", False),
    ("not_german", ("tion",), "anti", ("German", "Grammar"), 0.5, "ocr", False),
    ("not_reading", ("password", "token", "***"), "anti", ("Reading", "English"), 0.7, "ocr", False),
    ("brand", ("reserved", "licen", "copyright"), "anti", (UNCLASSIFIED,), 0.7, "meta", True),
    ("from_name", ("ingthe", "enund"), "pro", ("Reading",), 0.9, "filename", False),
)
# Subject, course.
COURSES = (("English", "Reading"), ("English", "Listening"), ("German", "Grammar"), ("French", "Conversation"), ("Science", "Physics 1"), ("Science", "Physics 2"), ("Mathematics", "Calculus"))
SUBJECTS = ("English", "German", "French", "Science", "Mathematics")
# Course aliases in order of preference; subject aliases.
COURSE_ALIASES = (("physics", "Physics 1"), ("reading", "Reading"), ("calc", "Calculus"), ("konversation", "Conversation"))
SUBJECT_ALIASES = (("engl", "English"), ("deutsch", "German"), ("fran", "French"), ("scien", "Science"), ("math", "Mathematics"))
# English function words.
FUNCTION_WORDS = ("the", "and", "of", "to", "that", "with", "for", "which", "this", "from", "what", "when", "because", "would", "could", "should", "their", "there", "about", "into", "your", "you", "have", "been", "will")
# Marks of answer books in names, and on covers.
SOLUTION_MARKS = ("solution", "answer", "key-", "erreur", "lyst")
SOLUTION_COVERS = ("answers and notes", "solutions manual", "answer key")
# Of covers, the phrase that a subject's name in is not meant, the notice of a listening test, marks of other books.
BOILERPLATE, LISTENING = "science ability test", "listen and answer"
OUTSIDE = ("workbook", "licensed under", "fan edition")
# In file names, words and the course or subject they stand for, in order; names of teachers with subject and course; names that are also words.
NAME_COURSES = (("reading", "Reading"), ("calc", "Calculus"), ("mech", "Physics 1"))
NAME_TEACHERS = (("drmueller", "German", "Grammar"), ("li", "Mathematics", "Calculus"), ("okafor", "Science", None), ("image", "Mathematics", None))
NAME_AMBIGUOUS = ("image",)
NAME_SUBJECTS = (("blog", "English"), ("/de/", "German"), ("science", "Science"))
# Courses that a long text without formulas speaks against.
FORMULA_COURSES = ("Calculus", "Physics 2")


def rule_rows() -> list[tuple]:
    """(rank, scan, keyword, polarity, targets, confidence, source, guard), in the total order of evaluation."""
    rows = [(scan, kw, pol, list(t), c, src, g) for scan, kws, pol, t, c, src, g in SCANS for kw in sorted(kws)]
    return [(i, *r) for i, r in enumerate(rows)]


def sql_array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def rules_sql() -> str:
    """The rules as a VALUES table r(rank, scan, keyword, polarity, targets, confidence, source, guard)."""
    rows = ", ".join(f"({i}, '{s}', '{k}', '{p}', {sql_array(t)}, CAST({c} AS DOUBLE), '{src}', {str(g).upper()})" for i, s, k, p, t, c, src, g in rule_rows())
    return f"(VALUES {rows}) r(rank, scan, keyword, polarity, targets, confidence, source, guard)"

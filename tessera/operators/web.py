"""Links out of HTML, and retrieval of reviewed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.evidence import holds_any

# Parts of the names of models that read images; the forms of links that pages of posts have are in the patterns below.
TOKENS = ("vision", "gemma", "llava", "qwen", "pixtral", "minicpm")
HREF = r"""(?i)href\s*=\s*["']([^"']+)["']"""


def links(html: Column) -> Column:
    """Targets in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)))


def absolute(url: Column) -> Column:
    return F.rlike(url, F.lit("^https?://"))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), -1)


def post_ids(html: Column, board: str) -> Column:
    """Ids of a board's posts, from the calls that open them; in order, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf"goView\('\Q{board}\E','(\d+)'"), F.lit(1)))


def attachments(html: Column) -> Column:
    """(id, name) of the PDF and ZIP files attached to a post, in order; either quote."""
    p = r"""(?i)fileDown\.do\?fileSeq=([a-f0-9]+)['"][^>]*>([^<]+\.(?:pdf|zip))"""
    ids, names = (F.regexp_extract_all(html, F.lit(p), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(ids.alias("id"), names.alias("name")), lambda x: F.struct(x.id.alias("id"), x["name"].alias("name")))


def pdf_links(html: Column) -> Column:
    """(url, name) of absolute links to PDF files; the name is the last segment."""
    urls = F.regexp_extract_all(html, F.lit(r'href="(https?://[^"]+\.pdf)"'), F.lit(1))
    return F.transform(urls, lambda u: F.struct(u.alias("url"), F.element_at(F.split(u, "/"), -1).alias("name")))


def named_any(name: Column, keys: list[str]) -> Column:
    """Names, composed, that hold any of the keys."""
    return holds_any(T.composed(name), keys)


def allowed(models: DataFrame, tokens: tuple[str, ...] = TOKENS, name: str = "name") -> DataFrame:
    """The models whose name holds a token; all of them where none does."""
    hit = F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.col(name), t))
    some = models.agg(F.coalesce(F.max(hit), F.lit(False)).alias("some")).scalar()
    return models.where(hit | ~some)


def similar(items: DataFrame, subject: str, unit: str, limit: int = 20, tie: str = "id") -> DataFrame:
    """Q10: reviewed items of a subject whose unit holds a string, whatever its case; ordered, so the limit is one answer."""
    return items.where((F.col("status") == "confirmed") & (F.col("subject") == subject) & F.contains(F.lower("unit"), F.lit(unit.lower()))).orderBy(tie).limit(limit)


def tags(items: DataFrame, by: list[str], note: str, most: dict[str, int]) -> DataFrame:
    """Sorted distinct tags of each prefix in a comma list, the first few of each. Tags are made distinct before they are ranked, and only the first few are brought together."""
    flat = items.select(*by, F.explode(F.split(note, ",")).alias("t")).select(*by, F.trim("t").alias("t")).distinct()
    kind, rest, limit = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0)
    for p, k in most.items():
        own = F.startswith("t", F.lit(p))
        kind, rest, limit = F.when(own, p.strip(":")).otherwise(kind), F.when(own, F.trim(F.substring("t", F.lit(len(p) + 1), F.length("t")))).otherwise(rest), F.when(own, k).otherwise(limit)
    kinds = flat.select(*by, kind.alias("kind_"), rest.alias("t"), limit.alias("most_")).distinct()
    place = F.row_number().over(Window.partitionBy(*by, "kind_").orderBy("t"))
    first = kinds.withColumn("r_", place).where((F.col("r_") <= max(most.values())) & (F.col("r_") <= F.col("most_")))
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind_") == p.strip(":"), F.col("t")))).alias(p.strip(":")) for p in most]
    # Groups without any tag stay, with empty lists.
    return kinds.select(*by).distinct().join(first.groupBy(*by).agg(*lists), by, "left").select(*by, *[F.coalesce(p.strip(":"), F.array().cast("array<string>")).alias(p.strip(":")) for p in most])


def rejected(items: DataFrame, subject: str, limit: int = 10, tie: str = "id") -> DataFrame:
    """Q11: notes of rejected items of a subject."""
    return items.where((F.col("status") == "rejected") & (F.col("subject") == subject) & (F.coalesce("note", F.lit("")) != "")).orderBy(tie).limit(limit).select(tie, "note")


def of_unit(items: DataFrame, unit: str, limit: int = 5, tie: str = "id") -> DataFrame:
    """Q12: confirmed items whose unit holds a string, whatever its case and whatever the subject."""
    return items.where((F.col("status") == "confirmed") & F.contains(F.lower("unit"), F.lit(unit.lower()))).orderBy(tie).limit(limit)


def union(*sets: DataFrame) -> DataFrame:
    """The rows of any of the sets, each once."""
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()

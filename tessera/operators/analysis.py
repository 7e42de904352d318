"""Analysed passages: a nested record of a model's reply, its fallback and its Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonfix
from tessera.functions import text as T

CHUNK, LINK, NODE = "struct<text:string,role:string,note:string>", "struct<src:int,dst:int,label:string>", "struct<id:string,label:string,relation:string>"
SENTENCE = f"struct<en:string,own:string,chunks:array<{CHUNK}>,mods:array<{LINK}>,grammar:array<string>>"
ANALYSIS = f"struct<title:string,summary:string,sentences:array<{SENTENCE}>,flow:array<{NODE}>,inference:string>"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def list_of(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def complete(a: Column) -> Column:
    """The record with defaults for all that is missing at any depth."""
    chunk = lambda c: F.struct(text_of(c["text"]).alias("text"), text_of(c["role"]).alias("role"), text_of(c["note"]).alias("note"))
    link = lambda m: F.struct(F.coalesce(m["src"], F.lit(0)).alias("src"), F.coalesce(m["dst"], F.lit(0)).alias("dst"), text_of(m["label"]).alias("label"))
    node = lambda n: F.struct(text_of(n["id"]).alias("id"), text_of(n["label"]).alias("label"), text_of(n["relation"]).alias("relation"))
    sentence = lambda s: F.struct(
        text_of(s["en"]).alias("en"), text_of(s["own"]).alias("own"), F.transform(list_of(s["chunks"], CHUNK), chunk).alias("chunks"), F.transform(list_of(s["mods"], LINK), link).alias("mods"),
        list_of(s["grammar"], "string").alias("grammar"),
    )
    return F.struct(
        text_of(a["title"]).alias("title"), text_of(a["summary"]).alias("summary"), F.transform(list_of(a["sentences"], SENTENCE), sentence).alias("sentences"),
        F.transform(list_of(a["flow"], NODE), node).alias("flow"), text_of(a["inference"]).alias("inference"),
    )


def flow(nodes: Column) -> Column:
    """The flow as a chart: a line for each node, by its place, and one for each edge from the one before."""
    plain = lambda s: F.replace(s, F.lit('"'), F.lit("'"))
    box = lambda n, i: F.concat(F.lit("  n_"), i.cast("string"), F.lit('["'), plain(F.coalesce(F.nullif(n["label"], F.lit("")), n["id"])), F.lit('"]'))
    arrow = lambda n: F.when(n["relation"] != "", F.concat(F.lit('-- "'), plain(n["relation"]), F.lit('" -->'))).otherwise("-->")
    edge = lambda n, i: F.concat(F.lit("  n_"), (i - 1).cast("string"), F.lit(" "), arrow(n), F.lit(" n_"), i.cast("string"))
    lines = F.concat(F.array(F.lit("flowchart TD")), F.transform(nodes, box), F.filter(F.transform(nodes, lambda n, i: F.when(i > 0, edge(n, i))), lambda x: x.isNotNull()))
    return F.when(F.size(nodes) == 0, "flowchart TD\n  A[text]").otherwise(F.array_join(lines, "\n"))


def sentence_lines(s: Column, i: Column) -> Column:
    """Markdown lines of a sentence: heading, text, its phrases with roles, its links, its translation and notes."""
    phrase = lambda c: F.rtrim(F.concat(c["text"], F.lit(" "), T.role_tag(c["role"])))
    arrows = F.when(F.size(s["chunks"]) > 0, F.array_join(F.transform(s["chunks"], phrase), "  ->  ")).otherwise(s["en"])
    named = lambda k: F.coalesce(F.when(k >= 0, F.get(s["chunks"], k)["text"]), F.concat(F.lit("#"), k.cast("string")))
    link = lambda m: F.concat(F.lit("- `"), named(m["src"]), F.lit("` -> `"), named(m["dst"]), F.lit("`"), F.when(m["label"] != "", F.concat(F.lit(" ("), m["label"], F.lit(")"))).otherwise(""))
    none = F.array().cast("array<string>")
    return F.concat(
        F.array(F.concat(F.lit("### Sentence "), i.cast("string")), F.concat(F.lit("> "), s["en"]), F.lit(""), F.lit("**Phrases**"), F.lit(""), F.concat(F.lit("`"), arrows, F.lit("`")), F.lit("")),
        F.when(F.size(s["mods"]) > 0, F.concat(F.array(F.lit("**Links**")), F.transform(s["mods"], link), F.array(F.lit("")))).otherwise(none),
        F.when(s["own"] != "", F.array(F.lit("**Translation**"), s["own"], F.lit(""))).otherwise(none),
        F.when(F.size(s["grammar"]) > 0, F.concat(F.array(F.lit("**Notes**")), F.transform(s["grammar"], lambda g: F.concat(F.lit("- "), g)), F.array(F.lit("")))).otherwise(none),
    )


def markdown(a: Column) -> Column:
    """The record as Markdown."""
    none = F.array().cast("array<string>")
    part = lambda head, body: F.when(body != "", F.array(F.lit(head), body, F.lit(""))).otherwise(none)
    parts = F.concat(
        F.array(F.concat(F.lit("# "), F.coalesce(F.nullif(a["title"], F.lit("")), F.lit("untitled"))), F.lit("")),
        part("## Summary", a["summary"]),
        F.array(F.lit("## Flow"), F.lit(""), F.lit("```mermaid"), flow(a["flow"]), F.lit("```"), F.lit(""), F.lit("## Sentences"), F.lit("")),
        F.flatten(F.transform(a["sentences"], lambda s, i: sentence_lines(s, i + 1))),
        part("## Inference", a["inference"]),
    )
    return F.array_join(parts, "\n")


def analyse(passages: DataFrame, text: str = "text", reply: str = "reply") -> DataFrame:
    """A passage is cleaned (F19); the model's reply, strict JSON, is its analysis; where that has no sentences, the passage's own (F21) stand in, each one phrase. Adds
    ``analysis`` and ``markdown``; passages without text are errors of their own row."""
    own = lambda s: F.struct(s.alias("en"), F.lit("").alias("own"), F.array(F.struct(s.alias("text"), F.lit("").alias("role"), F.lit("").alias("note"))).alias("chunks"), F.array().cast(f"array<{LINK}>").alias("mods"), F.array().cast("array<string>").alias("grammar"))
    df = passages.withColumn("clean_", T.clean_passage(F.col(text))).withColumn("reply_", jsonfix.strict(F.col(reply)))
    df = df.withColumn("a_", complete(F.from_json("reply_.value", ANALYSIS)))
    cut = F.transform(F.filter(F.transform(T.sentences(F.col("clean_")), T.strip), lambda s: s != ""), own)
    said = F.when(F.size("a_.sentences") > 0, F.col("a_.sentences")).otherwise(cut)
    df = df.withColumn("analysis", F.struct(F.col("a_.title").alias("title"), F.col("a_.summary").alias("summary"), said.alias("sentences"), F.col("a_.flow").alias("flow"), F.col("a_.inference").alias("inference")))
    return df.withColumn("error", F.when(F.coalesce(F.col("clean_"), F.lit("")) == "", "no text")).withColumn("markdown", F.when(F.col("error").isNull(), markdown(F.col("analysis")))).drop("clean_", "reply_", "a_")


def analysed(passages: DataFrame, stage: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """Passages analysed by a model, given as a stage that adds ``reply`` (``model.stage``)."""
    return analyse(stage(passages), text)

"""Pages: from words and blocks to columns, problem boxes, strips, lines and paragraphs.

Words are (doc, page, x0, y0, x1, y1, text), pages carry width and height. Recognition and rendering stay outside. Everything is grouped by page, which bounds what one
task holds at once: ``collect_list`` gathers the few dozen numbers of a page, never more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import layout, ranges
from tessera.sources import written

PAGE = ["doc", "page"]
#: Characters of text that pages of a document are brought together to before they are moved to it.
BLOCK = 1 << 20


SET_HEAD = r"^\[\s*\d{1,3}\s*[~～∼]\s*\d{1,3}\s*\]"


def use_text_layer(length: Column, images: Column) -> Column:
    """A text layer is trusted from 200 characters where the page has images, from 30 where it has none."""
    return length >= F.when(images, 200).otherwise(30)


def interval(x: Column, bounds: Column) -> Column:
    """Number of the first interval (left, right) that holds x, null for none. bounds: an array of structs."""
    hit = F.filter(F.transform(bounds, lambda b, i: F.struct(b.left.alias("left"), b.right.alias("right"), i.alias("i"))), lambda b: (b.left <= x) & (x < b.right))
    return F.get(hit, F.lit(0)).i


def rightmost(x: Column, bounds: Column) -> Column:
    """Number of the last interval that begins at x or before; the first where none does."""
    hit = F.filter(F.transform(bounds, lambda b, i: F.struct(b.left.alias("left"), i.alias("i"))), lambda b: b.left <= x)
    return F.coalesce(F.get(F.reverse(hit), F.lit(0)).i, F.lit(0))


def bounds_of(cols: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Columns (left, right) as one array a page, from left to right."""
    return cols.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("left", "right"))), lambda b: b).alias("bounds"))


def scored_columns(cands: DataFrame, by: list[str] = PAGE, width: str = "width") -> DataFrame:
    """Of candidates (x, y, num) the two islands of x (steps over 1.2 % of the width part them) whose numbers from top to bottom have the longest chain of
    successors, then the longest rising run, then most members, then the least x. One row a column, left to right: baseline, left, right (2 % wider)."""
    isl = layout.islands(cands, by, "x", F.col(width) * 0.012)
    seq = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "num"))), lambda p: p.num)
    per = isl.groupBy(*by, "island").agg(seq.alias("seq"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.first(width).alias("w_"))
    per = per.withColumns({"chain": layout.chain(F.col("seq")), "rise": F.size(layout.lis(F.col("seq"))), "n": F.size("seq")})
    best = Window.partitionBy(*by).orderBy(F.desc("chain"), F.desc("rise"), F.desc("n"), "lo")
    two = per.withColumn("r_", F.row_number().over(best)).where("r_ <= 2")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("lo")) - 1
    left, right = F.greatest(F.lit(0.0), F.col("lo") - F.col("w_") * 0.02), F.least(F.col("w_"), F.col("hi") + F.col("w_") * 0.02)
    return two.select(*by, place.alias("col"), F.col("lo").alias("baseline"), left.alias("left"), right.alias("right"), "chain", "rise", "n")


def keep_rising(cands: DataFrame, by: list[str] = PAGE, col: str = "col") -> DataFrame:
    """Of each column the candidates of a longest rising run from top to bottom."""
    rest = [c for c in cands.columns if c not in (*by, col)]
    rows = F.array_sort(F.collect_list(F.struct("y", "x", *[c for c in rest if c not in ("x", "y")])))
    per = cands.groupBy(*by, col).agg(rows.alias("rows"))
    kept = F.transform(layout.lis(F.transform("rows", lambda r: r.num)), lambda i: F.element_at("rows", i + 1))
    return per.select(*by, col, F.explode(kept).alias("r")).select(*by, col, *[F.col(f"r.{c}").alias(c) for c in rest])


def box_extents(cands: DataFrame, pages: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """W10 without strips: boxes of numbered starts in two columns: half a step (.6 % of the height) above each start to that above the next, the last to 97 %."""
    pad = F.col("height") * 0.006
    w = Window.partitionBy(*by, "col").orderBy("y", "x")
    rows = cands.join(pages, by).withColumns({"y0": F.greatest(F.col("y") - pad, F.lit(0.0)), "y1": F.coalesce(F.lead("y").over(w) - pad, F.col("height") * 0.97)})
    return rows.where("y1 > y0").withColumn("y1", F.least("y1", "height"))


def orphan_strips(cands: DataFrame, pages: DataFrame, words: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """What stands above a column's first start, if more than 4 % of the height below the highest start of the page and if a word lies in it, belongs to
    the last number of the column before. Rows: by, num, x0, y0, x1, y1."""
    pad = F.col("height") * 0.006
    ends = cands.groupBy(*by, "col").agg(F.min("y").alias("first"), F.max_by("num", F.struct("y", "x")).alias("last"), F.first("x0").alias("x0"), F.first("x1").alias("x1"))
    w = Window.partitionBy(*by).orderBy("col")
    top = F.min("first").over(Window.partitionBy(*by))
    strips = ends.withColumns({"num": F.lag("last").over(w), "top_": top}).join(pages, by)
    strips = strips.withColumns({"y0": F.greatest(F.col("top_") - pad, F.lit(0.0)), "y1": F.col("first") - pad}).where("num IS NOT NULL AND y1 - y0 > 0.04 * height")
    middle = words.select(*by, ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    held = strips.join(middle, by).where("my BETWEEN y0 AND y1 AND mx BETWEEN x0 AND x1")
    return held.select(*by, "col", "num", "x0", "y0", "x1", "y1").distinct()


def ocr_boxes(cands: DataFrame, pages: DataFrame, words: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Candidates (x, y, num, conf) of scanned pages to boxes: gates (P08), columns (W03), membership (J09), rising runs (W06), stragglers (W08),
    mended numbers (W09), boxes and strips (W10). Rows: by, col, seq (reading order), num, x0, y0, x1, y1."""
    pages = written(pages)
    good = written(cands.where("num BETWEEN 1 AND 50 AND conf >= 30").join(pages, by))
    cols = scored_columns(good, by)
    per = cols.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("bounds"), F.max(F.when(F.col("col") == 1, F.col("baseline"))).alias("second"))
    placed = good.join(per, by).withColumn("col", interval(F.col("x"), F.col("bounds"))).where("col IS NOT NULL")
    gutter = F.coalesce(F.col("second") - F.col("width") * 0.05, F.col("width"))
    placed = placed.withColumns({"x0": F.when(F.col("col") == 0, F.lit(0.0)).otherwise(gutter), "x1": F.when(F.col("col") == 0, gutter).otherwise(F.col("width"))}).drop("bounds", "second", "width", "height")
    kept = layout.repair_sequence(layout.drop_stragglers(keep_rising(placed, by), by, "col", "num"), by, "col", "y", "num").drop("num").withColumnRenamed("repaired", "num")
    kept = written(kept)
    boxes = box_extents(kept, pages, by).select(*by, "col", "num", "x0", "y0", "x1", "y1", F.lit(1).alias("k_"))
    strips = orphan_strips(kept, pages, words, by).withColumn("k_", F.lit(0))
    seq = F.row_number().over(Window.partitionBy(*by).orderBy("col", "k_", "y0"))
    return boxes.unionByName(strips).withColumn("seq", seq).drop("k_").withColumn("x0", F.greatest("x0", F.lit(1.0)))


def starts(blocks: DataFrame, pages: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """W11, first part: blocks (x0, y0, text) within 7 % and 95 % of the height that begin with a number of 1 to 50 (not a set's heading), as (y, x, num, body). If a page has
    fewer than two, its bare numbers of two or three digits, if they stand in valid islands (W07, steps of 1.5 % of the width), take their place."""
    inside = blocks.join(pages, by).withColumn("t_", T.strip(F.col("text"))).where("y0 BETWEEN height * 0.07 AND height * 0.95")
    own = F.when(~F.rlike("t_", F.lit(SET_HEAD)), T.problem_number(F.col("t_")))
    read = inside.select(*by, F.col("y0").alias("y"), F.col("x0").alias("x"), "width", own.alias("num"), (F.length(T.number_rest(F.col("t_"))) >= 2).alias("body"), T.bare_number(F.col("t_")).alias("bare"))
    # Written, as four branches read it: texts are gone through once.
    read = written(read.select("*", F.explode_outer(F.array((F.col("num").between(1, 50)))).alias("marked")).where("marked OR bare IS NOT NULL"))
    marked = read.where("marked").select(*by, "y", "x", "num", "body")
    bare = read.where("bare IS NOT NULL").select(*by, "y", "x", F.col("bare").alias("num"), F.lit(True).alias("body"), "width")
    valid = layout.valid_islands(bare, by, "x", "y", "num", F.col("width") * 0.015).select(*by, "y", "x", "num", "body")
    many = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    sizes = many(marked, "marked").join(many(valid, "valid"), by, "full_outer").select(*by, ((F.coalesce("marked", F.lit(0)) < 2) & (F.coalesce("valid", F.lit(0)) >= 2)).alias("bare"))
    return marked.join(sizes, by).where("NOT bare").drop("bare").unionByName(valid.join(sizes, by).where("bare").drop("bare"))


def heads(blocks: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """F23 over blocks: headings of sets, with their range and place."""
    r = T.set_range(F.col("text"))
    return blocks.withColumn("r_", r).where("r_ IS NOT NULL").select(*by, F.col("r_.s").alias("s"), F.col("r_.e").alias("e"), "x0", "y0", "x1", "y1")


def next_head(found: Column, left: Column, right: Column, y: Column) -> Column:
    """The nearest heading of a column more than 5 below y; null without one. found: the page's headings, an array of (x0, y0)."""
    return F.array_min(F.transform(F.filter(found, lambda h: (h.x0 >= left) & (h.x0 < right + 1) & (h.y0 > y + 5)), lambda h: h.y0))


def content_bottom(blocks: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """The lowest edge of the page's blocks whose middle lies in a column (2 wider) and whose top lies between two heights; null without one."""
    inside = lambda b: ((b.x0 + b.x1) / 2).between(left - 2, right + 2) & (b.y0 >= top) & (b.y0 < bottom)
    return F.array_max(F.transform(F.filter(blocks, inside), lambda b: b.y1))


def marked_boxes(blocks: DataFrame, pages: DataFrame, by: list[str] = PAGE, least: float = 18.0, begun: DataFrame | None = None) -> DataFrame:
    """W11 over starts: without doubles (A13), in columns (W01); a start nearer than ``least`` to the last one kept is none; a box ends above the next start or the
    next set's heading, and 6 under its content. Rows: by, num, x0, y0, x1, y1. begun: the starts, if they are known."""
    found = written(layout.dedup_starts(starts(blocks, pages, by) if begun is None else begun, by, "num", "y", "body", "x").join(pages, by))
    cols = layout.columns(found, by, "x", F.col("width")).join(found.groupBy(*by).agg(F.min("x").alias("least_"), F.first("width").alias("w_")), by)
    only = F.count("*").over(Window.partitionBy(*by)) == 1
    alone = F.when(F.col("least_") > F.col("w_") * 0.25, F.greatest(F.col("least_") - 15, F.lit(0.0))).otherwise(0.0)
    cols = cols.withColumns({"left": F.when(only, alone).otherwise(F.greatest(F.lit(0.0), F.col("left"))), "right": F.when(only, F.col("w_")).otherwise(F.least("w_", "right"))}).select(*by, "left", "right")
    placed = found.select(*by, "y", "x", "num").join(cols, by).where("x >= left AND x < right + 1")
    order = F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "num")))
    fold = lambda acc, s: F.when((F.size(acc) == 0) | (s.y - F.element_at(acc, -1).y >= least), F.concat(acc, F.array(s))).otherwise(acc)
    kept = placed.groupBy(*by, "left", "right").agg(order.alias("ys")).withColumn("ys", F.aggregate("ys", F.slice("ys", 1, 0), fold))
    kept = kept.select(*by, "left", "right", F.explode("ys").alias("s")).select(*by, "left", "right", "s.*").join(pages, by)
    inside = blocks.join(pages, by).where("y0 BETWEEN height * 0.07 AND height * 0.95 AND text RLIKE '" + SET_HEAD.replace("\\", "\\\\") + "'")
    sets = inside.groupBy(*by).agg(F.collect_list(F.struct("x0", "y0")).alias("heads"))
    content = blocks.groupBy(*by).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("content"))
    top, low = F.col("height") * 0.07, F.col("height") * 0.95
    after = F.lead("y").over(Window.partitionBy(*by, "left").orderBy("y"))
    boxes = kept.join(sets, by, "left").join(content, by, "left").withColumn("y_end", F.least(F.coalesce(after, low), next_head(F.col("heads"), F.col("left"), F.col("right"), F.col("y"))))
    boxes = boxes.withColumns({"y0": F.greatest(F.col("y") - 8, top), "y1": F.least(F.col("y_end") - 4, low)})
    end = content_bottom(F.col("content"), F.col("left"), F.col("right"), F.col("y0"), F.col("y1"))
    boxes = boxes.withColumn("end_", end).withColumn("y1", F.when(F.col("end_") > F.col("y0"), F.least(F.col("y1"), F.col("end_") + 6)).otherwise(F.col("y1")))
    return boxes.select(*by, F.col("num").cast("string").alias("num"), F.greatest("left", F.lit(5.0)).alias("x0"), "y0", F.least("right", F.col("width") - 5).alias("x1"), "y1")


def word_clusters(words: DataFrame, pages: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Rows of words parted where one begins over 20 under the end of the word before it (by its top), as full-width boxes numbered from above;
    those wholly in the margins (7 %, 95 % of the height) go."""
    # A row a page from the shuffle on: what a task sorts is one list of four numbers a word, once.
    per = words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "y1", "x1"))).alias("w_")).join(pages.select(*by, "width", "height"), by)
    begins = F.filter(F.transform("w_", lambda w, i: F.when((i == 0) | (w.y0 - F.get("w_", i - 1).y1 > 20), i)), lambda i: i.isNotNull())
    per = per.withColumn("i_", begins)
    row = lambda i, k: F.slice("w_", i + 1, F.coalesce(F.get("i_", k + 1), F.size("w_")) - i)
    spans = F.transform(F.transform("i_", row), lambda r: F.struct(F.array_min(F.transform(r, lambda w: w.y0)).alias("a_"), F.array_max(F.transform(r, lambda w: w.y1)).alias("b_")))
    held = F.filter(spans, lambda r: (r.a_ < F.col("height") * 0.95) & (r.b_ > F.col("height") * 0.07))
    rows = per.select(*by, "width", "height", F.posexplode(held).alias("k_", "r_"))
    num = (F.col("k_") + 1).cast("string")
    return rows.select(*by, num.alias("num"), F.lit(0.0).alias("x0"), F.greatest(F.col("r_.a_") - 4, F.lit(0.0)).alias("y0"), F.col("width").alias("x1"), F.least(F.col("r_.b_") + 4, "height").alias("y1"))


def problem_boxes(blocks: DataFrame, words: DataFrame, pages: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """Boxes of starts; of pages without any, clusters of words."""
    pages = written(pages)
    begun = written(starts(blocks, pages, by))
    marked = marked_boxes(blocks, pages, by, begun=begun)
    bare = words.join(begun.select(*by).distinct(), by, "left_anti")
    return marked.unionByName(word_clusters(bare, pages, by))


def scan_pages(pages: DataFrame, length: str = "n_text", images: str = "has_images", first: int = 16, doc: str = "doc") -> DataFrame:
    """The first pages of a document to be recognised: under 60 characters of text, and images."""
    w = Window.partitionBy(doc).orderBy("page")
    return pages.where(F.col(images) & (F.col(length) < 60)).withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= first).drop("r_")


def clip_text(boxes: DataFrame, words: DataFrame, pages: DataFrame, by: list[str] = PAGE, box: str = "num") -> DataFrame:
    """The words of a box (2 wider), by bands of a hundredth of the height and then x, one to a line. A box of a page without any words has null, one without words of its
    own has an empty text. Each word of a page is held against each of its boxes, so time, not memory, grows with the two together."""
    band = F.greatest(F.col("height") / 100, F.lit(1.0))
    # All by page, so that words and boxes are moved once each; a page's words are put in order once for all of its boxes.
    list_ = F.collect_list(F.struct("x0", "y0", "x1", "y1", "text"))
    per = words.groupBy(*by).agg(list_.alias("w_")).join(pages.select(*by, "height", F.lit(True).alias("page_")), by, "left")
    of = F.transform("w_", lambda w: F.struct(F.bround(w.y0 / band).alias("band"), w.x0.alias("x"), w.text.alias("text"), w.y0.alias("y"), w.x1.alias("wx1"), w.y1.alias("wy1")))
    per = per.select(*by, F.when(F.col("page_"), F.array_sort(of)).alias("o_"), F.lit(True).alias("some_"))
    own = boxes.select(*by, box, "x0", "y0", "x1", "y1").repartition(*by).distinct().join(per, by, "left")
    inside = lambda o: o.x.between(F.col("x0") - 2, F.col("x1") + 2) & o.y.between(F.col("y0") - 2, F.col("y1") + 2) & (o.wx1 <= F.col("x1") + 2) & (o.wy1 <= F.col("y1") + 2)
    text = F.when(F.col("some_"), F.coalesce(F.array_join(F.transform(F.filter("o_", inside), lambda o: o.text), "\n"), F.lit("")))
    return own.select(*by, box, "x0", "y0", "x1", "y1", text.alias("text"))


def set_strips(sets: DataFrame, boxes: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """From 2 above a set's heading (s, e, y0, y1) to the top of the first box below it, in that box's width; null sides without a box or at 8 or less of height."""
    b = boxes.select(*by, F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"))
    found = sets.join(b, by, "left").withColumn("below", F.when(F.col("by0") >= F.col("y1") - 2, F.struct("by0", "bx0", "bx1")))
    first = found.groupBy(*by, "s", "e", "y0", "y1").agg(F.min("below").alias("f"))
    top = F.greatest(F.col("y0") - 2, F.lit(0.0))
    ok = F.col("f.by0") - top > 8
    return first.select(*by, "s", "e", F.when(ok, F.col("f.bx0")).alias("x0"), F.when(ok, top).alias("y0"), F.when(ok, F.col("f.bx1")).alias("x1"), F.when(ok, F.col("f.by0")).alias("y1"))


def set_texts(members: DataFrame, strips: DataFrame, doc: str = "doc") -> DataFrame:
    """J02's shared text: a set's strip and its members' texts that are not blank, in order of page and number."""
    full = lambda c: F.filter(c, lambda t: T.strip(F.coalesce(t, F.lit(""))) != "")
    own = members.groupBy(doc, "s", "e", "rpage").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "num", "text"))), lambda m: m.text).alias("texts"))
    return own.join(strips.select(doc, "s", "e", "rpage", F.col("text").alias("strip")), [doc, "s", "e", "rpage"], "left").select(doc, "s", "e", "rpage", F.array_join(full(F.concat(F.array("strip"), "texts")), "\n").alias("set_text"))


def problems(unboxed: DataFrame, boxed: DataFrame, most: int = 300, doc: str = "doc") -> DataFrame:
    """The rows of a document: pages without boxes (number p) first, then its boxes in reading order (``seq``), up to ``most``; texts cut at 900 characters."""
    a = unboxed.select(doc, "page", F.lit("p").alias("num"), "text", F.lit(0).alias("k_"), F.col("page").cast("long").alias("seq"))
    b = boxed.select(doc, "page", F.col("num").cast("string").alias("num"), "text", F.lit(1).alias("k_"), F.col("seq").cast("long").alias("seq"))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("k_", "page", "seq", "num", "text"))
    return a.unionByName(b).withColumn("place", place).where(F.col("place") <= most).select(doc, "place", "page", "num", F.substring("text", 1, 900).alias("text"))


def word_lines(words: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """W14, first part: words (with block and line) joined to lines, left to right; a line stands where its least x and y are."""
    rest = words.where(T.strip(F.col("text")) != "").groupBy(*by, "block", "line")
    order = F.array_sort(F.collect_list(F.struct("x0", "y0", "text")))
    return rest.agg(order.alias("o"), F.min("x0").alias("x"), F.min("y0").alias("y")).select(*by, "x", "y", F.array_join(F.transform("o", lambda w: w.text), " ").alias("text"))


def read_lines(lines: DataFrame, pages: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """W13 over lines (x, y, text): in columns found from x, bands of 12 of y within a column, then x; blank lines go. Adds ``ord``."""
    # Written, as columns are found from them and they are put in these.
    lines = written(lines.where(T.strip(F.coalesce("text", F.lit(""))) != "").join(pages.select(*by, "width"), by))
    per = bounds_of(layout.columns(lines, by, "x", F.col("width")).select(*by, "left", "right"), by)
    placed = lines.join(per, by).withColumn("col", rightmost(F.col("x"), F.col("bounds")))
    w = Window.partitionBy(*by).orderBy("col", F.bround(F.col("y") / 12), "x", "text")
    return placed.withColumn("ord", F.row_number().over(w)).select(*by, "ord", "x", "y", "text")


def with_formulas(lines: DataFrame, formulas: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """J07 and union: lines whose place lies in a formula's box go, the formulas (x1, y1, x2, y2, tex) that are not blank come as $tex$ lines where their boxes begin."""
    kept = ranges.outside(lines.select(*by, "x", "y", "text"), formulas, by)
    made = formulas.where(T.strip(F.col("tex")) != "").select(*by, F.col("x1").alias("x"), F.col("y1").alias("y"), F.concat(F.lit("$"), "tex", F.lit("$")).alias("text"))
    return kept.unionByName(made)


def formula_boxes(found: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes of a layout model that are labelled as formulas, scored ``least`` or more and at least 4 wide and high within the page."""
    w, h = F.floor(F.least("x2", "width")) - F.floor(F.greatest("x1", F.lit(0.0))), F.floor(F.least("y2", "height")) - F.floor(F.greatest("y1", F.lit(0.0)))
    return found.where(F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lit("formula")) & (F.coalesce("score", F.lit(0.0)) >= least) & (w >= 4) & (h >= 4))


def transcribe(words: DataFrame, recognised: DataFrame, formulas: DataFrame, pages: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """A page's paragraphs. Pages whose layer is trusted (S06: n_text, has_images) give lines of their words, the others recognised lines (x, y, text) with
    formulas in place; in reading order, cleaned (F18), without empty ones, with an empty paragraph before each numbered one but the first (F20)."""
    layer = pages.withColumn("layer", use_text_layer(F.col("n_text"), F.col("has_images")))
    own, scanned = layer.where("layer").select(*by), layer.where("NOT layer").select(*by)
    lines = word_lines(words.join(own, by), by).unionByName(with_formulas(recognised, formulas, by).join(scanned, by).select(*by, "x", "y", "text"))
    clean = read_lines(lines, pages, by).withColumn("text", T.clean_transcription(F.col("text"))).where("text <> ''")
    per = clean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda o: o.text).alias("p"))
    return pages.select(*by).join(per, by, "left").select(*by, T.structured(F.coalesce("p", F.array().cast("array<string>"))).alias("paragraphs"))


def page_texts(paragraphs: DataFrame, doc: str = "doc") -> DataFrame:
    """A row a page: its paragraphs that are not empty, and its joined text, null where it has no paragraphs at all."""
    full = F.size(F.filter("paragraphs", lambda x: x != "")).cast("long")
    return paragraphs.select(doc, "page", full.alias("paragraphs"), F.when(F.size("paragraphs") > 0, F.array_join("paragraphs", "\n")).alias("text"))


def transcript(paragraphs: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages, paragraphs that are not empty and the joined text of each document, which is held whole as it is one value; ``transcript_digests`` holds no document."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p.text), "\n")
    return page_texts(paragraphs, doc).groupBy(doc).agg(F.count("*").alias("pages"), F.sum("paragraphs").alias("paragraphs"), text.alias("text"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over rows (doc, page, paragraphs, text) in order: neighbours of one document as rows (doc, first page, pages, paragraphs, text) of about BLOCK characters."""
    types, doc, parts = None, None, []
    page, pages, full, size = None, 0, 0, 0

    def block() -> pa.RecordBatch:
        row = (doc, page, pages, full, "\n".join(parts) if parts else None)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["doc", "page", "pages", "paragraphs", "text"])

    for batch in batches:
        types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.int64(), pa.string()]
        for d, p, n, text in zip(*(c.to_pylist() for c in batch.columns)):
            if pages and (d != doc or size >= BLOCK):
                yield block()
                parts, pages, full, size = [], 0, 0, 0
            if not pages:
                doc, page = d, p
            pages += 1
            full += n
            if text is not None:
                parts.append(text)
                size += len(text) + 1
    if pages:
        yield block()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map over blocks in order: a row (doc, pages, paragraphs, text_sha256) a document; the digest is null where no page has a paragraph."""
    kind, doc, pages, full, sha = None, None, 0, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([doc], kind), pa.array([pages], pa.int64()), pa.array([full], pa.int64()), pa.array([sha and sha.hexdigest()], pa.string())], ["doc", "pages", "paragraphs", "text_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for d, _, n, m, text in zip(*(c.to_pylist() for c in batch.columns)):
            if pages and d != doc:
                yield row()
                pages, full, sha = 0, 0, None
            doc, pages, full = d, pages + n, full + m
            if text is not None:
                if sha is None:
                    sha = hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(text.encode())
    if pages:
        yield row()


def transcript_digests(paragraphs: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages, paragraphs that are not empty and the SHA-256 of the joined text of each document (null without any). Pages are dealt out in ranges of (doc, page) and joined to
    blocks there; a document's blocks then pass through its digest one after another, so no task holds more than a batch of them."""
    n = int(paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, as dealing out in ranges would else make the pages twice.
    rows = written(page_texts(paragraphs, doc).withColumnRenamed(doc, "doc"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    dealt = rows.repartitionByRange(n, "doc", "page").sortWithinPartitions("doc", "page")
    blocks = dealt.mapInArrow(_joined, f"doc {kinds['doc']}, page {kinds['page']}, pages long, paragraphs long, text string")
    sums = blocks.repartition(n, "doc").sortWithinPartitions("doc", "page").mapInArrow(_digested, f"doc {kinds['doc']}, pages long, paragraphs long, text_sha256 string")
    return sums.withColumnRenamed("doc", doc)


def extracts(unboxed: DataFrame, boxed: DataFrame, by: list[str] = PAGE) -> DataFrame:
    """What a page is extracted as: its boxes with their number as label, or, without any, the page under the label full; texts cut at 800 characters."""
    # Cut before they are moved; pages with boxes are hashed by key, so that texts are not sorted.
    cut = F.substring(F.coalesce("text", F.lit("")), 1, 800).alias("text")
    bare = unboxed.select(*by, F.lit("full").alias("label"), cut).join(boxed.select(*by).distinct().hint("shuffle_hash"), by, "left_anti")
    return boxed.select(*by, F.col("num").cast("string").alias("label"), cut).unionByName(bare)

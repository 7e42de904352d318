"""Merkle manifest of a dataset: built bottom-up over persisted levels, proofs pushed top-down.

A leaf is the digest of a row's fields, each with its length in front. The leaves of a language, in order, are the lowest level of its tree; every eight
consecutive nodes become one node of the next level, each level being a table with one row a node that is written before the next is made. The
languages' last nodes are, in order of language, the leaves of one more tree of the same kind, whose last node is the root. Proofs go the other way: a node's
path is the siblings beside it, put before the path of its parent, by a join of each level with the one above. Keys of all groupings and joins
are (tree, number of the parent), eight rows each, so no language is ever in one task; positions come from ranges of the order and their counts.

A path is an array of (left, right), the siblings of a level that stand before and after the node; a digest is folded with it level by level.

Defined cases: rows with a null doc_id come first in their language; equal doc_ids are ordered by leaf; a null language is a language of its own, before all
others. A text of any length is one row. Repeated rows are leaves each. An empty table has no rows and no root; a table of one row has its leaf as root and an empty proof.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, documents, written

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One in so many rows, by crc32 of the id, is tampered with.
TAMPERED = 3
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's fields, some of which may be given."""
    return digest(*(field(changed.get(c, F.col(c))) for c in FIELDS))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, given): ``given`` is the leaf that a check is handed, which differs where the row was tampered with. ``tree`` is the language, marked so that null sorts first."""
    low = F.translate("text", "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    own = leaf()
    given = F.when(hit & (low != F.col("text")), leaf(text=low)).otherwise(own)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(*FIELDS).select(tree.alias("tree"), "doc_id", own.alias("leaf"), given.alias("given"))


def placed(nodes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with ``pos``, their number from 0 within ``by``, and ``n``, the rows of ``by``. Rows are dealt in ranges of the order, equal rows over several, and numbered by the
    counts of the ranges before, a row for each range and group."""
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = nodes.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *by, *order, "salt").drop("salt")
    dealt = written(spark, salted.sortWithinPartitions(*by, *order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = dealt.groupBy(*by, "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    w = Window.partitionBy(*by).orderBy("part")
    counts = counts.select(*by, "part", "first", (F.sum("rows").over(w) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy(*by)).alias("n"))
    out = dealt.join(counts, [*by, "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")
    kept = written(spark, out)
    discard(dealt)
    return kept


def grown(spark: SparkSession, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels above (tree, pos, n, hash), from the lowest, each (tree, pos, n, kids, hash), and the last node of each tree (tree, hash)."""
    levels, tops = [], nodes.where("n = 1").select("tree", "hash")
    below, most = nodes, nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // ARITY)
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda k: k.hash)
        up = below.where("n > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("up"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("m")).agg(kids.alias("kids"))
        below = written(spark, up.select("tree", F.col("up").alias("pos"), F.col("m").alias("n"), "kids", F.sha2(F.array_join("kids", ""), 256).alias("hash")))
        levels.append(below)
        tops = tops.union(below.where("n = 1").select("tree", "hash"))
    return levels, tops


def pushed(spark: SparkSession, nodes: DataFrame, levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest nodes with their paths and what ``ends``, one row a tree, has for it: its ``path`` is the suffix of all paths of the tree."""
    more = [c for c in ends.columns if c not in ("tree", "path")]
    top = None
    for k in range(len(levels) - 1, -1, -1):
        level, below = levels[k], levels[k - 1] if k else nodes
        # The level's nodes with their paths: those that end a tree have the tree's, others were pushed to.
        own = level.where("n = 1").join(ends, "tree").select("tree", "pos", "kids", "path", *more)
        above = own if top is None else own.union(top.select("tree", "pos", "kids", "path", *more))
        above = above.select("tree", F.col("pos").alias("up"), F.col("kids").alias("siblings"), F.col("path").alias("suffix"), *more)
        at = (F.col("pos") % ARITY).cast("int")
        left = F.array_join(F.slice("siblings", F.lit(1), at), "")
        right = F.array_join(F.slice("siblings", at + 2, F.lit(ARITY)), "")
        path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("suffix"))
        joined = below.where("n > 1").withColumn("up", F.expr(f"pos div {ARITY}")).join(above, ["tree", "up"]).withColumn("path", path).drop("up", "siblings", "suffix")
        top = written(spark, joined) if k else joined
    alone = nodes.where("n = 1").join(ends, "tree")
    return alone if top is None else top.unionByName(alone.select(*top.columns))


def folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p.left, h, p.right), 256))


def proof(path: Column) -> Column:
    """The siblings of all levels end to end, from the leaf's to the root's."""
    return F.array_join(F.transform(path, lambda p: F.concat(p.left, p.right)), "")


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each document: its leaf, its tree's and the whole root, its proof, and what the given leaf folds to."""
    spark = docs.sparkSession
    # Written first, as dealing in ranges reads its input twice and the texts are large.
    hashed = written(spark, leaves(docs))
    low = placed(hashed, ["tree"], ["doc_id", "leaf"]).withColumnRenamed("leaf", "hash")
    discard(hashed)
    levels, tops = grown(spark, low)
    # The trees' last nodes are the leaves of the tree above: one tree, named by a constant.
    trees = placed(tops.withColumn("all", F.lit("")), ["all"], ["tree"]).withColumnRenamed("tree", "own").withColumnRenamed("all", "tree")
    over, root = grown(spark, trees)
    end = root.select("tree", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    subroots = pushed(spark, trees, over, end).select(F.col("own").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    out = pushed(spark, low, levels, written(spark, subroots))
    fold = folded(F.col("given"), F.col("path"))
    rows = out.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)) END"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 of ASCII digits, a bit at a time.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) // 2, 3988292384 * (xor(a, b) % 2))), 4294967295)"""


def _climb(name: str, start: str, kids: str) -> str:
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT c.* REPLACE (k + 1 AS k, pos // 8 AS pos, (n + 7) // 8 AS n, c.proof || array_to_string(hs[:pos % 8] || hs[pos % 8 + 2:], '') AS proof,
    sha256(array_to_string(hs[:pos % 8], '') || c.fold || array_to_string(hs[pos % 8 + 2:], '')) AS fold)
  FROM {name} c JOIN {kids} ON {kids}.k2 = c.k AND {kids}.tree2 = c.tree AND {kids}.up = c.pos // 8 WHERE c.n > 1)"""


def _levels(name: str, start: str) -> str:
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT k + 1, tree, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY k, tree, pos // 8, n),
{name}_kids AS (SELECT k AS k2, tree AS tree2, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(concat({", ".join(_FIELD.format(c) for c in FIELDS)})) AS h,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256(concat({", ".join(_FIELD.format(_LOW if c == "text" else c) for c in FIELDS)})) END AS given FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
{_levels("lev", "SELECT 0 AS k, tree, pos, h, n FROM base")},
subs AS (SELECT tree AS own, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lev WHERE n = 1),
{_levels("over", "SELECT 0 AS k, '' AS tree, pos, subroot AS h, n FROM subs")},
{_climb("low", "SELECT doc_id, h AS leaf, tree, 0 AS k, pos, n, '' AS proof, coalesce(given, h) AS fold FROM base", "lev_kids")},
{_climb("high", "SELECT low.* REPLACE ('' AS tree, 0 AS k, subs.pos AS pos, subs.n AS n), subroot FROM low JOIN subs ON own = low.tree WHERE low.n = 1", "over_kids")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM high, (SELECT h AS root FROM over WHERE n = 1) WHERE n = 1
"""

"""Benchmark decontamination with a generalised suffix automaton.

The benchmark items are normalised to lower-case words and put into one suffix automaton. Training texts stream
through it word by word; the state and the current longest matching length tell, at each word, which items' windows of
``window`` words (or whole items of fewer) end there. Words within such occurrences are hit. ``clean`` cuts the spans
of at least ``min_span`` hit words and drops documents of which more than ``max_coverage`` of the words are hit.

Only stretches whose neighbouring word pairs all occur in some item are given to the automaton; a window cannot lie
elsewhere. Items are split by a hash into shards of about ``SHARD_BYTES``, each with an automaton of its own, built alone and packed into flat sorted arrays (about 6 bytes for
each byte of items). A pass over the texts takes ``PASS`` shards; further shards take further passes, whose hits come as small tables by a digest of the text
and are joined. So what a task holds does not grow with the benchmark.

Defined cases: null or wordless texts have no words and no hits; items without words match nothing; an item with a
null item_id hits words but is not listed; items with equal ids count once; repeated documents each get a row; a very long text is taken whole, in one task. Columns
other than doc_id and text are ignored by ``report`` and kept by ``clean``. An empty table of documents gives no rows, one of items no hits.
"""

from __future__ import annotations

import functools
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle as pickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ALNUM, U64, Words, discard, documents, mix, pieces, utf8, written

WINDOW = 10
SHARD_BYTES = 2 << 20
#: Shards whose automata a task holds at once.
PASS = 4
#: Bits of the filter of known word pairs.
FILTER_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return ALNUM[raw].tobytes().split()


class Builder:
    """Suffix automaton of several word sequences, with the items that own each window; ``Automaton`` is what it is packed into."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: dict[int, set[str]] = {}
        #: (state, length) of the items shorter than a window.
        self.short: dict[tuple[int, int], set[str]] = {}
        sequences = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        ends: list[tuple[int, str | None]] = []
        for name, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
                ends.append((last, name)) if len(words) >= window else None
        for name, words in sequences:
            if len(words) < window:
                v = 0
                for w in words:
                    v = self.next[v][w]
                self.short.setdefault((v, len(words)), set()).update([] if name is None else [name])
        for v, name in ends:
            while v > 0 and self.length[v] >= window:
                if self.length[self.link[v]] < window:
                    self.owners.setdefault(v, set()).update([] if name is None else [name])
                v = self.link[v]
        self.short_lengths = sorted({n for _, n in self.short})
        self.least = min([*self.short_lengths, window]) if self.short_lengths or self.owners else 0
        self.known = np.zeros(1 << FILTER_BITS, bool)
        for _, words in items:
            if words:
                raw = np.frombuffer(b" ".join(words), np.uint8)
                h = Words(raw, np.array([0, len(raw)]), ALNUM).hashes()
                self.known[self._slots(h if self.least == 1 else pair(h))] = True

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - FILTER_BITS)).astype(np.int64)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of state q that holds only what p reaches by w."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new



class Automaton:
    """A packed automaton. Transitions are sorted by (state, word); owners of windows by state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        made = Builder(items, window)
        self.window, self.least, self.short_lengths = window, made.least, made.short_lengths
        self.vocabulary = made.vocabulary
        self.base = max(1, len(made.vocabulary))
        moves = sorted((v * self.base + w, to) for v, edges in enumerate(made.next) for w, to in edges.items())
        self.key, self.to = array("Q", [k for k, _ in moves]), array("i", [t for _, t in moves])
        self.link, self.length = array("i", made.link), array("i", made.length)
        self.names = sorted({n for own in (*made.owners.values(), *made.short.values()) for n in own})
        number = {n: i for i, n in enumerate(self.names)}
        states = sorted(made.owners)
        self.owned = array("i", states)
        self.owner_at = array("i", [0])
        self.owner = array("i")
        for v in states:
            self.owner.extend(sorted(number[n] for n in made.owners[v]))
            self.owner_at.append(len(self.owner))
        self.short = {k: tuple(sorted(number[n] for n in own)) for k, own in made.short.items()}
        self.packed = np.packbits(made.known)
        self.known: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    @staticmethod
    def _slots(h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - FILTER_BITS)).astype(np.int64)

    def step(self, v: int, w: int) -> int:
        """The state that w leads to from v, or -1."""
        k = v * self.base + w
        i = bisect_left(self.key, k)
        return self.to[i] if i < len(self.key) and self.key[i] == k else -1

    def walk(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges of words (merged, end exclusive) and the owners of the windows that occur."""
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        link, length, step = self.link, self.length, self.step
        v = n = 0
        for i, word in enumerate(words):
            w = self.vocabulary.get(word)
            if w is None:
                v = n = 0
                continue
            to = step(v, w)
            while v and to < 0:
                v = link[v]
                n = length[v]
                to = step(v, w)
            v, n = (to, n + 1) if to >= 0 else (0, 0)
            reach = 0
            for m in self.short_lengths:
                if m > n:
                    break
                u = v
                while length[link[u]] >= m:
                    u = link[u]
                if (u, m) in self.short:
                    owners.update(self.short[u, m])
                    reach = m
            if n >= self.window:
                u = v
                while length[link[u]] >= self.window:
                    u = link[u]
                k = bisect_left(self.owned, u)
                owners.update(self.owner[self.owner_at[k] : self.owner_at[k + 1]])
                reach = self.window
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, {self.names[k] for k in owners}

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int, int, int]], set[str]]]]:
        """Number of words of each row; for rows with hits, spans (words from, to, bytes from, to, within the row) and items."""
        w = Words(data, offsets, ALNUM)
        count = np.diff(w.first)
        found: dict[int, tuple[list[tuple[int, int, int, int]], set[str]]] = {}
        if not self.least or not len(w):
            return count, found
        if self.known is None:
            self.known = np.unpackbits(self.packed).view(bool)
        h = w.hashes()
        row = np.repeat(np.arange(len(count)), count)
        reach = 1 if self.least == 1 else 2
        ok = self.known[self._slots(h if reach == 1 else pair(h))]
        if reach == 2:
            ok &= row[1:] == row[:-1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        a, b = edges[::2], edges[1::2] + reach - 1
        if reach == 1:  # runs may span rows
            cuts = w.first[1:-1]
            inside = np.flatnonzero(np.diff(row)) + 1
            cuts = inside[(np.searchsorted(a, inside, "right") - np.searchsorted(b, inside, "right")) > 0]
            a, b = np.sort(np.concatenate([a, cuts])), np.sort(np.concatenate([b, cuts]))
        keep = b - a >= self.least
        text = w.text
        for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
            words = text[w.start[i] : w.end[j - 1]].tobytes().split()
            spans, owners = self.walk(words)
            if spans:
                r = int(row[i])
                own = found.setdefault(r, ([], set()))
                base, at = int(w.first[r]), int(offsets[r])
                own[0].extend((i + s - base, i + e - base, int(w.start[i + s]) - at, int(w.end[i + e - 1]) - at) for s, e in spans)
                own[1].update(owners)
        for spans, _ in found.values():
            spans.sort()
            merged: list[tuple[int, int, int, int]] = []
            for s in spans:
                if merged and s[0] <= merged[-1][1]:
                    last = merged.pop()
                    s = (last[0], max(last[1], s[1]), last[2], max(last[3], s[3]))
                merged.append(s)
            spans[:] = merged
        return count, found


def pair(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U64(3) + h[1:]) if len(h) > 1 else h[:0]


def automata(items: DataFrame, window: int = WINDOW) -> list:
    """A broadcast automaton for each shard of the items; a shard is collected alone."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = -(-size // SHARD_BYTES)
    out = []
    for k in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        rows = [(r.item_id, words_of(r.text)) for r in own.collect()]
        out.append(spark.sparkContext.broadcast(pickle.dumps(Automaton(rows, window))))
    return out


SPAN = "array<struct<word:long,word_end:long,at:long,end:long>>"
_FIELDS = ("word", "word_end", "at", "end")


def found_in(batch: pa.RecordBatch, autos: list[Automaton]) -> tuple[np.ndarray, dict[int, list], dict[int, set[str]]]:
    """Number of words of each row; of rows with hits the spans and items over several automata."""
    data, offsets = utf8(batch.column("text"))
    count = np.zeros(len(batch), np.int64)
    spans: dict[int, list] = {}
    items: dict[int, set[str]] = {}
    for x, y in pieces(offsets, 4 << 20):
        for auto in autos:
            count[x:y], found = auto.find(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            for r, (own, names) in found.items():
                spans[x + r] = join([*spans.get(x + r, []), *own])
                items.setdefault(x + r, set()).update(names)
    return count, spans, items


def as_spans(rows: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(_FIELDS, s, strict=True)) for s in row] for row in rows], pa.list_(pa.struct([pa.field(n, pa.int64()) for n in _FIELDS])))


def passes(shared: list) -> list[list]:
    return [shared[i : i + PASS] for i in range(0, len(shared), PASS)]


def hits(docs: DataFrame, shared: list) -> DataFrame:
    """key (a digest of the text), spans and items of the texts that some shard hits, each text once; a pass for every few shards."""

    def one(some: list) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            autos = [pickle.loads(b.value) for b in some]
            for batch in batches:
                _, spans, items = found_in(batch, autos)
                rows = sorted(spans)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), as_spans([spans[r] for r in rows]), pa.array([sorted(items[r]) for r in rows], pa.list_(pa.string()))], ["key", "spans", "items"])

        return docs.select("key", "text").mapInArrow(step, f"key binary, spans {SPAN}, items array<string>").dropDuplicates(["key"])

    found = functools.reduce(DataFrame.union, [one(p) for p in passes(shared)])
    gathered = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [join([tuple(s.values()) for s in row]) for row in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), as_spans(rows), batch.column("items")], ["key", "spans", "items"])

    return gathered.mapInArrow(merged, f"key binary, spans {SPAN}, items array<string>")


def text_key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def scan(docs: DataFrame, shared: list) -> DataFrame:
    """doc_id, n_words, and the hit spans (bytes of the text's UTF-8) and items of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = len(shared) <= PASS

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = [pickle.loads(b.value) for b in shared] if once else []
        autos = autos or [Automaton([])]
        for batch in batches:
            count, spans, items = found_in(batch, autos)
            rows = range(len(batch))
            own = [] if once else [batch.column("key")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count), as_spans([spans.get(r, []) for r in rows]), pa.array([sorted(items.get(r, [])) for r in rows], pa.list_(pa.string())), *own],
                ["doc_id", "n_words", "spans", "items", *(["key"] if own else [])],
            )

    schema = f"doc_id long, n_words long, spans {SPAN}, items array<string>"
    if once:
        return docs.mapInArrow(step, schema)
    docs = docs.withColumn("key", text_key())
    counted = docs.mapInArrow(step, f"{schema}, key binary").select("doc_id", "n_words", "key")
    met = hits(docs, shared)
    return counted.join(met, "key", "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def join(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            last = out.pop()
            s = (last[0], max(last[1], s[1]), last[2], max(last[3], s[3]))
        out.append(s)
    return out


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    out = scan(docs, automata(items, window))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.word_end - s.word)
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """The same columns; hit spans of min_span words or more are cut out (a line end takes their place) until none is left,
    documents with more than max_coverage of their words hit are dropped. n_chars, where there is one, follows the text."""
    shared = automata(items, window)
    if len(shared) < 2:
        return edited(docs, shared, min_span, max_coverage)
    # An automaton sees its own shard alone, so spans are gathered from all before any cut; the rows that were cut go round again.
    spark, first, done = docs.sparkSession, True, []
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    while True:
        before, rows = rows, written(spark, trimmed(marked(rows, shared), min_span, max_coverage if first else None))
        discard(before)
        done.append(rows.where("not again").select("row.*"))
        if not rows.where("again").limit(1).count():
            return functools.reduce(DataFrame.union, done)
        rows, first = written(spark, rows.where("again").select("row")), False


def marked(rows: DataFrame, shared: list) -> DataFrame:
    """row, its number of words, and spans, the hit spans over all shards (four numbers each)."""
    text = rows.select("row", F.col("row.text").cast("string").alias("text")).withColumn("key", text_key())
    met = hits(text, shared).withColumn("spans", F.flatten(F.transform("spans", lambda s: F.array(s.word, s.word_end, s["at"], s.end))))
    count = Automaton([])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, _, _ = found_in(batch, [count])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n), batch.column("spans")], ["row", "words", "spans"])

    joined = text.join(met, "key", "left").select("row", "text", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))
    return joined.mapInArrow(words, T.StructType([joined.schema["row"], T.StructField("words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType()))]))


def quads(flat: list[int]) -> list[tuple[int, int, int, int]]:
    return list(zip(*[iter(flat)] * 4, strict=True))


def trimmed(docs: DataFrame, min_span: int, max_coverage: float | None) -> DataFrame:
    """One round over marked rows: those over max_coverage (None: not asked) dropped, spans cut out; again tells which rows were cut."""
    names = docs.schema["row"].dataType.fieldNames()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pa.RecordBatch.from_struct_array(batch.column("row"))
            raw = row.column(names.index("text"))
            words, drop, changed = batch.column("words").to_pylist(), [], {}
            for r, flat in enumerate(batch.column("spans").to_pylist()):
                spans = [s for s in quads(flat) if s[1] - s[0] >= min_span]
                if max_coverage is not None and sum(s[1] - s[0] for s in spans) > max_coverage * words[r]:
                    drop.append(r)
                elif spans:
                    changed[r] = cut(raw[r].as_py().encode(), spans).decode()
            again = np.zeros(len(batch), bool)
            again[list(changed)] = True
            out = replaced(row, names, drop, changed)
            yield pa.RecordBatch.from_arrays([out.to_struct_array(), pa.array(np.delete(again, drop))], ["row", "again"])

    return docs.mapInArrow(step, T.StructType([docs.schema["row"], T.StructField("again", T.BooleanType())]))


def replaced(batch: pa.RecordBatch, names: list[str], drop: list[int], changed: dict[int, str]) -> pa.RecordBatch:
    """The batch with changed texts (n_chars, where there is one, follows) and without the dropped rows."""
    if changed:
        cols = list(batch.columns)
        k = names.index("text")
        text = cols[k].to_pylist()
        for r, s in changed.items():
            text[r] = s
        cols[k] = pa.array(text, cols[k].type)
        if "n_chars" in names:
            k = names.index("n_chars")
            n = cols[k].to_pylist()
            for r, s in changed.items():
                n[r] = len(s)
            cols[k] = pa.array(n, cols[k].type)
        batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
    if drop:
        keep = np.ones(len(batch), bool)
        keep[drop] = False
        batch = batch.filter(pa.array(keep))
    return batch


def edited(docs: DataFrame, shared: list, min_span: int, max_coverage: float) -> DataFrame:
    """``clean`` with one automaton, in one stage."""
    schema = docs.schema
    names = docs.columns
    for b in shared:

        def step(batches: Iterator[pa.RecordBatch], b=b) -> Iterator[pa.RecordBatch]:
            auto: Automaton = pickle.loads(b.value)
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                drop, changed = [], {}
                for x, y in pieces(offsets, 4 << 20):
                    count, found = auto.find(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                    for r, (spans, _) in found.items():
                        spans = [s for s in spans if s[1] - s[0] >= min_span]
                        if sum(s[1] - s[0] for s in spans) > max_coverage * count[r]:
                            drop.append(x + r)
                        elif spans:
                            raw = data[offsets[x + r] : offsets[x + r + 1]]
                            while spans:
                                raw = np.frombuffer(cut(raw.tobytes(), spans), np.uint8)
                                _, again = auto.find(raw, np.array([0, len(raw)]))
                                spans = [s for s in again[0][0] if s[1] - s[0] >= min_span] if again else []
                            changed[x + r] = raw.tobytes().decode()
                yield replaced(batch, names, drop, changed)

        docs = docs.mapInArrow(step, T.StructType(schema.fields))
    return docs


def cut(raw: bytes, spans: list[tuple[int, int, int, int]]) -> bytes:
    parts, at = [], 0
    for _, _, a, b in spans:
        parts += [raw[at:a], b"\n"]
        at = b
    return b"".join([*parts, raw[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS k FROM i WHERE len(w) > 0)),
cand AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, k, cand.n, item_id FROM cand JOIN win ON cand.s = win.s AND cand.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN own USING (r)
"""

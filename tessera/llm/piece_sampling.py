"""Sampled segmentation over a SentencePiece vocabulary, and its lossless decoding.

All segmentations of a text into pieces form a lattice; their probability is the product of the pieces'. Forward filtering gives the total
weight of the paths into each place, backward sampling then draws one path from its end, with uniforms hashed from the row key, the chunk's
place in the text and the step. So a row gives the same sample wherever and whenever it runs. No piece crosses from a
letter into a blank, so a chunk (blanks, then what follows up to the next blank) is sampled by itself, and the lattice
of each distinct chunk of a block of texts is built once, with numpy over all of them. A long chunk (text without blanks, say) is cut where no piece of its
lattice crosses: all paths go through such a place, so the parts are independent. What has no such place (a run of one letter) is filtered a byte at a time, each place drawing
its edge as it is reached.

The vocabulary is a BPE one and has ranks, no probabilities: the piece of rank r weighs (r + 2.7) ** -1.07 (Zipf's law), to the power
``sharpness``. Characters without a piece are spelled in byte pieces, so nothing is lost; a literal U+2581 is spelled in bytes too,
as that character stands for the blank. As the library does, a blank is put before the text and taken off again.

Defined cases: null counts as empty; an empty text has no pieces; a null row key samples as the key -1 does; rows with equal keys and texts get equal
samples. A text of more than ``BLOCK`` bytes is taken in parts of about that size, cut at a blank or where no piece crosses, so memory is bounded whatever its length. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle as pickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, documents, mix, pieces, powers, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 64
#: Bytes of text whose lattices are built at once, and among which a cut of a longer one is sought at a time.
BLOCK, SEEK = 1 << 19, 1 << 12
#: Lattice weights get this factor for each byte, which all paths share, so that products stay in range.
PER_BYTE = 30.0
BITS = 22
_P = U64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Piece bytes and weights, with hash tables of the pieces and of their prefixes."""

    def __init__(self, model: str = MODEL, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte_id = np.zeros(256, np.int32)
        table: dict[bytes, int] = {}
        spelled = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                spelled[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                spelled[i] = name.replace("▁", " ").encode()
                table[spelled[i]] = i
        rank = np.array([-sp.get_score(i) for i in range(len(spelled))])
        size = np.array([len(s) for s in spelled])
        weight = (np.clip(rank, 0, len(spelled)) + 2.7) ** (-1.07 * sharpness)
        weight[self.byte_id] = 0.1 * (len(spelled) + 2.7) ** (-1.07 * sharpness)
        self.weight = weight * PER_BYTE**size
        self.table = table
        self.log_weight = np.log(weight)
        self.longest = max(map(len, table))
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.size = size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        names = sorted(table)
        code = np.array([code_of(s) for s in names], np.uint64)
        order = np.argsort(spread(code))
        self.code, self.code_id = code[order], np.array([table[names[k]] for k in order], np.int32)
        #: Where the codes of each leading 16 bits (of their spread) begin.
        self.first = np.searchsorted(spread(self.code) >> U64(48), np.arange((1 << 16) + 1, dtype=np.uint64))
        prefixes = np.array([code_of(p) for p in {s[:k] for s in names for k in range(1, len(s) + 1)}], np.uint64)
        self.is_prefix = np.zeros(1 << BITS, bool)
        self.is_prefix[slots(prefixes)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and the ids of those."""
        top = (spread(h) >> U64(48)).astype(np.int64)
        low, high = self.first[top], self.first[top + 1]
        found = np.zeros(len(h), bool)
        at = np.zeros(len(h), np.int64)
        left = np.flatnonzero(low < high)
        while len(left):
            same = self.code[low[left]] == h[left]
            hit = left[same]
            found[hit], at[hit] = True, low[hit]
            left = left[~same]
            low[left] += 1
            left = left[low[left] < high[left]]
        return found, self.code_id[at[found]]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes that pieces spell, with the blank before the text."""
        n = self.size[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.data[np.repeat(self.start[ids] - (ends - n), n) + np.arange(int(ends[-1]))]


def code_of(s: bytes) -> int:
    h = 0
    for c in s:
        h = (h * 0x9E3779B97F4A7C15 + c + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def step_code(step: int) -> np.uint64:
    return U64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def spread(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> U64(31))) * U64(0xBF58476D1CE4E5B9)


def slots(h: np.ndarray) -> np.ndarray:
    return (spread(h) >> U64(64 - BITS)).astype(np.int64)


def edges(v: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte places) and pieces of all lattice edges of the chunks in ``data``."""
    end_of = np.repeat(bounds[1:], np.diff(bounds))
    idx = np.arange(len(data))
    h = np.zeros(len(data), np.uint64)
    starts, stops, ids = [], [], []
    lead = (data & 0xC0) != 0x80
    width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
    spelled = lead.copy()
    for n in range(1, v.longest + 1):
        h = h * _P + (data[idx + n - 1].astype(np.uint64) + U64(1))
        ok = v.is_prefix[slots(h)]
        idx, h = idx[ok], h[ok]
        found, piece = v.lookup(h)
        at = idx[found]
        starts.append(at)
        stops.append(at + n)
        ids.append(piece)
        spelled[at[width[at] == n]] = False
        ok = end_of[idx] > idx + n
        idx, h = idx[ok], h[ok]
        if not len(idx):
            break
    raw = np.flatnonzero(spelled)
    raw = np.concatenate([raw, *((raw[width[raw] > k] + k) for k in (1, 2, 3))])
    raw = raw[raw < len(data)]
    starts.append(raw)
    stops.append(raw + 1)
    ids.append(v.byte_id[data[raw]])
    return np.concatenate(starts), np.concatenate(stops), np.concatenate(ids)


def sample_chunks(v: Vocabulary, data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One sample for each occurrence (its chunk's number, its seed): pieces end to end, and how many each has."""
    chunk = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    a, b, piece = edges(v, data, bounds)
    owner = chunk[a]
    place = b - bounds[owner]
    order = np.argsort(place.astype(np.uint8) if LONG < 256 else place, kind="stable")
    a, b, piece, owner, place = a[order], b[order], piece[order], owner[order], place[order]
    # Places of chunk c are its bytes' and one more, after the last.
    a, b = a + owner, b + owner
    alpha = np.zeros(len(data) + len(bounds) - 1)
    first = bounds[:-1] + np.arange(len(bounds) - 1)
    alpha[first] = 1.0
    w = v.weight[piece]
    steps = np.searchsorted(place, np.arange(1, int(place.max()) + 2)) if len(place) else np.zeros(1, int)
    for i, j in zip(steps, steps[1:], strict=False):
        np.add.at(alpha, b[i:j], alpha[a[i:j]] * w[i:j])
    total = alpha[b]
    share = np.divide(alpha[a] * w, total, out=np.zeros(len(a)), where=total > 0)
    # By place, then falling shares (to 16 bits; the order only shortens the search): one sort of words that hold both and the number.
    if len(alpha) < 1 << 22 and len(a) < 1 << 26:
        word = b.astype(np.uint64) << U64(42) | np.where(share > 0, (1 - share) * 65534, 65535).astype(np.uint64) << U64(26) | np.arange(len(a), dtype=np.uint64)
        word.sort()
        order = (word & U64((1 << 26) - 1)).astype(np.int64)
    else:
        order = np.lexsort((-share, b))
    a, b, piece, share = a[order], b[order], piece[order], share[order]
    cum = np.cumsum(share)
    begin = np.searchsorted(b, np.arange(len(alpha)))
    stop = np.append(begin[1:], len(b))
    base = np.concatenate([[0.0], cum])[begin]
    cum -= base[b]
    last = np.zeros(len(b), bool)
    last[stop[stop > begin] - 1] = True
    cum[last] = 2.0
    # Zero shares come last within a place; the edge before them must end the search.
    dead = share <= 0
    cum[:-1][dead[1:] & (b[1:] == b[:-1]) & ~dead[:-1]] = 2.0
    # Occurrences by chunk, and all of an edge in one record, so that what is looked up lies together.
    edge = np.empty(len(b), [("cum", np.float64), ("a", np.int32), ("piece", np.int32)])
    edge["cum"], edge["a"], edge["piece"] = cum, a, piece
    live = np.argsort(kind, kind="stable")
    kind, own = kind[live], seed[live]
    at, goal = (bounds[1:] + np.arange(len(bounds) - 1))[kind], first[kind]
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    count = np.zeros(len(kind), np.int64)
    while len(live):
        u = (mix(own + step_code(step)) >> U64(11)).astype(np.float64) * 2.0**-53
        e = begin[at]
        drawn = edge[e]
        move = np.flatnonzero(drawn["cum"] <= u)
        while len(move):
            e[move] += 1
            further = edge[e[move]]
            drawn[move] = further
            move = move[further["cum"] <= u[move]]
        taken.append((live, drawn["piece"].copy()))
        count[live] += 1
        at = drawn["a"].astype(np.int64)
        more = at != goal
        if not more.all():
            live, at, goal, own = live[more], at[more], goal[more], own[more]
        step += 1
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for k, (who, what) in enumerate(taken):
        out[ends[who] - 1 - k] = what
    return out, count


def free_places(v: Vocabulary, data: np.ndarray) -> np.ndarray:
    """Which places of a byte run no lattice edge crosses: one more than it has bytes, the ends among them."""
    a, b, _ = edges(v, data, np.array([0, len(data)]))
    inner = b - a > 1
    change = np.bincount(a[inner] + 1, minlength=len(data) + 2) - np.bincount(b[inner], minlength=len(data) + 2)
    return np.cumsum(change)[: len(data) + 1] == 0


def sample_long(v: Vocabulary, chunk: np.ndarray, seed: int) -> np.ndarray:
    """One sample of a chunk of any length, a byte at a time. The edge by which a place would be reached is drawn as soon as its weight is known, by a uniform of the
    place; the path is then followed from the end. Weights are kept for as many places as the longest piece spans, and scaled back when they grow out of range."""
    n, far = len(chunk), v.longest + 4
    came, by = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    alpha = {0: 1.0}
    for at in range(0, n, BLOCK):
        a, b, piece = edges(v, chunk[at : at + BLOCK + far], np.array([0, min(n - at, BLOCK + far)]))
        mine = a < BLOCK
        if at:  # edges over the cut, from the block before
            x, y, z = edges(v, chunk[at - far : at + far], np.array([0, min(n - at + far, 2 * far)]))
            over = (x < far) & (y > far)
            a, b, piece = np.concatenate([a[mine], x[over] - far]), np.concatenate([b[mine], y[over] - far]), np.concatenate([piece[mine], z[over]])
        else:
            a, b, piece = a[mine], b[mine], piece[mine]
        mine = b <= BLOCK
        a, b, piece = a[mine], b[mine], piece[mine]
        order = np.argsort(b, kind="stable")
        a, b, piece = a[order] + at, b[order] + at, piece[order]
        first = np.searchsorted(b, np.arange(at + 1, at + min(BLOCK, n - at) + 2)).tolist()
        u = ((mix(U64(seed) + np.arange(at + 1, at + len(first), dtype=np.uint64) * step_code(1)) >> U64(11)).astype(np.float64) * 2.0**-53).tolist()
        starts, names, weight = a.tolist(), piece.tolist(), v.weight[piece].tolist()
        for i in range(len(first) - 1):
            k = at + i + 1
            terms = [alpha.get(starts[e], 0.0) * weight[e] for e in range(first[i], first[i + 1])]
            total = sum(terms)
            alpha.pop(k - far, None)
            if total <= 0.0:
                continue
            alpha[k] = total
            goal, e = u[i] * total, first[i]
            for t in terms:
                goal -= t
                if goal < 0.0 and t > 0.0:
                    break
                e += 1
            else:
                e = first[i] + max(j for j, t in enumerate(terms) if t > 0.0)
            came[k], by[k] = starts[e], names[e]
            if not 1e-150 < total < 1e150:
                alpha = {p: w / total for p, w in alpha.items()}
    out, k, back, pieces_ = [], n, came.tolist() if n < 1 << 16 else came, by
    while k:
        out.append(int(pieces_[k]))
        k = int(back[k])
    return np.array(out[::-1], np.int32)


def parts(v: Vocabulary, data: np.ndarray) -> list[tuple[int, int]]:
    """A long text's parts of BLOCK bytes or little more, cut before a blank that follows other text, else where no piece crosses."""
    cuts, at, n = [0], BLOCK, len(data)
    while at < n:
        own = data[at : at + SEEK]
        blank = np.flatnonzero((own == 32) & (data[at - 1 : at - 1 + len(own)] != 32))
        if len(blank):
            cut = at + int(blank[0])
        else:
            low = at - v.longest
            free = free_places(v, data[low : at + SEEK + v.longest])[v.longest : v.longest + SEEK]
            lead = (own & 0xC0) != 0x80
            found = np.flatnonzero(free[: len(own)] & lead)
            cut = at + int(found[0]) if len(found) else 0
        if cut:
            cuts.append(cut)
            at = cut + BLOCK
        else:
            at += SEEK
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def encode(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, part: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all rows end to end, the n + 1 bounds of the rows' pieces; and the bytes encoded (each row with its blank) with their bounds. Later parts of a text get no blank."""
    n = np.diff(offsets)
    full = (n > 0) & (part == 0)
    bounds = offsets + np.concatenate([[0], np.cumsum(full)])
    text = np.full(int(bounds[-1]), 32, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.cumsum(full), n)] = data
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(len(n) + 1, np.int64), text, bounds
    blank = text == 32
    new = blank.copy()
    new[1:] &= ~blank[:-1]
    new[bounds[:-1][n > 0]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(text)))
    row = np.searchsorted(bounds, start, "right") - 1
    nth = np.arange(len(start)) - np.searchsorted(start, bounds[:-1])[row]
    seed = mix(mix(keys)[row] + nth.astype(np.uint64) * U64(0xD1B54A32D192ED03) + U64(part << 40))
    if (size > LONG).any():
        more, at = [np.stack([start, np.arange(len(start)), np.zeros(len(start), np.int64)], 1)], np.flatnonzero(size > LONG)
        for k in at.tolist():
            a, b = int(start[k]), int(start[k] + size[k])
            for x in range(a, b, BLOCK):
                low = max(a, x - v.longest)
                free = free_places(v, text[low : min(b, x + BLOCK + v.longest)])[x - low : x - low + min(BLOCK, b - x)]
                cuts = x + np.flatnonzero(free & ((text[x : x + len(free)] & 0xC0) != 0x80))
                cuts = cuts[cuts > a]
                more.append(np.stack([cuts, np.full(len(cuts), k), cuts - a], 1))
        units = np.concatenate(more)
        units = units[np.argsort(units[:, 0], kind="stable")]
        start, seed = units[:, 0], seed[units[:, 1]]
        later = units[:, 2] > 0
        seed[later] = mix(seed[later] + units[later, 2].astype(np.uint64) * U64(0xA0761D6478BD642F))
        size = np.diff(np.append(start, len(text)))
    short = size <= LONG
    where = np.flatnonzero(short)
    within = np.arange(len(text)) - np.repeat(start, size)
    terms = mix(np.arange(1, 257, dtype=np.uint64))[text] * powers(LONG)[np.minimum(within, LONG - 1)]
    h = mix(np.add.reduceat(terms, start) + size.astype(np.uint64))
    _, one, kind = np.unique(h[where], return_index=True, return_inverse=True)
    at, own = start[where[one]], size[where[one]]
    cuts = np.concatenate([[0], np.cumsum(own)])
    chunks = text[np.repeat(at - cuts[:-1], own) + np.arange(int(cuts[-1]))]
    ids, count = sample_chunks(v, chunks, cuts, kind, seed[where]) if len(where) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    if short.all():
        total = count
        out = ids
    else:
        total = np.zeros(len(start), np.int64)
        total[where] = count
        long = {int(k): sample_long(v, text[start[k] : start[k] + size[k]], int(seed[k])) for k in np.flatnonzero(~short)}
        for k, p in long.items():
            total[k] = len(p)
        ends = np.cumsum(total)
        out = np.zeros(int(ends[-1]), np.int32)
        mine = np.repeat(short, total)
        out[mine] = ids
        for k, p in long.items():
            out[ends[k] - len(p) : ends[k]] = p
    ends = np.concatenate([[0], np.cumsum(total)])
    return out, ends[np.searchsorted(start, bounds)], text, bounds


def encode_column(docs: DataFrame, key: str = "doc_id", model: str = MODEL, sharpness: float = 1.0) -> DataFrame:
    """key and pieces (array<int>) of each row's text."""
    return _mapped(docs, key, model, sharpness, digest=False)


def decode_column(ids: Column, model: str = MODEL) -> Column:
    """The text that an array of pieces spells."""
    packed = pickle.dumps(Vocabulary(model))

    @F.pandas_udf("string")
    def run(column):
        v = pickle.loads(packed)
        return column.map(lambda x: None if x is None else v.decode(np.asarray(x, np.int64)).tobytes()[1:].decode())

    return run(ids)


def _mapped(docs: DataFrame, key: str, model: str, sharpness: float, digest: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Vocabulary(model, sharpness)))
    names = ["doc_id", "n_pieces", "n_byte_pieces", "pieces_sha256", "decoded_sha256", "lossless"] if digest else [key, "pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = pickle.loads(shared.value)
        is_byte = np.zeros(len(v.size), bool)
        is_byte[v.byte_id] = True
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            seeds = np.array([-1 if k is None else k for k in batch.column("seed").to_pylist()], np.int64).view(np.uint64)
            for x, y in pieces(offsets, BLOCK):
                if offsets[y] - offsets[x] > BLOCK:  # one long text
                    own = data[offsets[x] : offsets[y]]
                    found, sums, text_sum, back_sum, ok = [], np.zeros(2, np.int64), hashlib.sha256(), hashlib.sha256(), True
                    for k, (a, b) in enumerate(parts(v, own)):
                        ids, _, text, _ = encode(v, own[a:b], np.array([0, b - a]), seeds[x:y], k)
                        if not digest:
                            found.append(ids)
                            continue
                        made = v.decode(ids)
                        ok = ok and np.array_equal(made, text)
                        text_sum.update(ids)
                        back_sum.update(made[1:] if k == 0 else made)
                        sums += len(ids), int(is_byte[ids].sum())
                    if digest:
                        yield pa.RecordBatch.from_arrays([batch.column("id").slice(x, 1), pa.array(sums[:1]), pa.array(sums[1:]), pa.array([text_sum.hexdigest()]), pa.array([back_sum.hexdigest()]), pa.array([ok])], names)
                    else:
                        ids = np.concatenate(found)
                        yield pa.RecordBatch.from_arrays([batch.column("id").slice(x, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names)
                    continue
                ids, ends, text, bounds = encode(v, data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], seeds[x:y])
                if not digest:
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(x, y - x), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names)
                    continue
                made = v.decode(ids)
                cuts = np.concatenate([[0], np.cumsum(v.size[ids])])[ends]
                spelled = np.concatenate([[0], np.cumsum(is_byte[ids])])[ends]
                rows = range(y - x)
                back = [made[cuts[i] + 1 : cuts[i + 1]] for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(x, y - x),
                        pa.array(np.diff(ends)),
                        pa.array(np.diff(spelled), pa.int64()),
                        pa.array([hashlib.sha256(ids[ends[i] : ends[i + 1]]).hexdigest() for i in rows], pa.string()),
                        pa.array([hashlib.sha256(s).hexdigest() for s in back], pa.string()),
                        pa.array([np.array_equal(s, text[bounds[i] + 1 : bounds[i + 1]]) for s, i in zip(back, rows, strict=True)], pa.bool_()),
                    ],
                    names,
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = "doc_id long, n_pieces long, n_byte_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean" if digest else f"`{key}` {kind}, pieces array<int>"
    seed = F.col(key).cast("long") if kind in ("bigint", "int") else F.xxhash64(key)
    return docs.select(F.col(key).alias("id"), seed.alias("seed"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Counts and digests: the pieces as little-endian 32-bit numbers, the text decoded from them, whether it is the text given."""
    return _mapped(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", model, 1.0, digest=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))

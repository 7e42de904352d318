"""Minimum-cost repair of chat roles.

Legal conversations are an optional system turn and then user and assistant turns in alternation, beginning with a user's; an automaton
over the last role (none, system, user, assistant) knows them. Each turn is kept, relabelled, or merged into the turn before it, and empty
turns may be inserted before it; dynamic programming finds the cheapest way through, and the repaired turns are rendered.

Turns are numbered in order, in ranges over all tasks, and a conversation is cut at every ``SPAN`` of them, so neither a long conversation nor many turns of equal or
no number come to one task. Each stretch gives the least cost from each state to each, a matrix;
the matrices of a conversation are multiplied (min, +) to find the states between the stretches, and each stretch is then traced by
itself. So a very long conversation is spread over many tasks, and only 16 numbers for each stretch meet in one.

Defined cases: turns are in the order of turn (null first), then role and text; null text is empty; null and unknown roles fit no state and are always
relabelled; a null conv_id is a conversation; repeated rows are turns like others. Markup of the rendering within a text is broken up
by a blank, so texts cannot forge turns. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, written
from tessera.operators.layout import place

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
ALIASES = {"system": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
MERGE, RELABEL, INSERT = 1, 3, 2
SPAN = 256
FAR = 1 << 40
#: Roles to insert between a last role and the next so that it is legal; pairs not listed are never legal.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
SCHEMA = "conv_id long, turn long, role string, new_role string, action string, inserted string, cost long, rendered string"


def role_of(name: str | None) -> int:
    return ALIASES.get((name or "").strip().lower(), START)


def moves(role: int) -> list[tuple[int, int, int, bool]]:
    """(from, to, cost, merged) of a turn with a role, cheapest first for each pair of states."""
    out = [(p, q, INSERT * len(mid) + RELABEL * (q != role), False) for (p, q), mid in BETWEEN.items()]
    out += [(p, p, MERGE + RELABEL * (p != role), True) for p in (SYSTEM, USER, ASSISTANT)]
    return sorted(out, key=lambda m: (m[0], m[1], m[2], m[3]))


MOVES = {r: moves(r) for r in range(4)}


def advance(cost: list[int], role: int) -> list[int]:
    out = [FAR] * 4
    for p, q, c, _ in MOVES[role]:
        out[q] = min(out[q], cost[p] + c)
    return out


def matrix(roles: list[int]) -> list[list[int]]:
    rows = [[0 if p == q else FAR for q in range(4)] for p in range(4)]
    for r in roles:
        rows = [advance(row, r) for row in rows]
    return rows


def trace(roles: list[int], entry: int, leave: int) -> list[tuple[int, int, int, bool]]:
    """The moves of a cheapest path between two states; of equal ones the first by state, then keeping before merging."""
    costs = [[0 if p == entry else FAR for p in range(4)]]
    for r in roles:
        costs.append(advance(costs[-1], r))
    out, at = [], leave
    for i in range(len(roles) - 1, -1, -1):
        move = next(m for m in MOVES[roles[i]] if m[1] == at and costs[i][m[0]] + m[2] == costs[i + 1][at])
        out.append(move)
        at = move[0]
    return out[::-1]


def states(matrices: list[list[list[int]]]) -> list[tuple[int, int]]:
    """States before and after each stretch on a cheapest path from the start to any end."""
    costs = [[0, FAR, FAR, FAR]]
    for m in matrices:
        costs.append([min(costs[-1][p] + m[p][q] for p in range(4)) for q in range(4)])
    at = min(range(4), key=lambda q: (costs[-1][q], q))
    out = []
    for i in range(len(matrices) - 1, -1, -1):
        before = min(range(4), key=lambda p: (costs[i][p] + matrices[i][p][at], p))
        out.append((before, at))
        at = before
    return out[::-1]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each (conv_id, part), which come together."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = (row["conv_id"], row["part"])
            if rows and k != key:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def costs_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = ((k, matrix([role_of(r["role"]) for r in rows])) for k, rows in groups(batches))
    for (conv, part), m in found:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([sum(m, [])], pa.list_(pa.int64()))], ["conv_id", "part", "m"])


def link_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's parts: states before and after, and whether it is the first and the last."""
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            parts = row["parts"]
            found = states([[p["m"][i : i + 4] for i in range(0, 16, 4)] for p in parts])
            out += [(row["conv_id"], p["part"], a, b, i == 0, i + 1 == len(parts)) for i, (p, (a, b)) in enumerate(zip(parts, found, strict=True))]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "part", "entry", "leave", "first", "last"])


def clean(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for (conv, _), rows in groups(batches):
        path = trace([role_of(r["role"]) for r in rows], rows[0]["entry"], rows[0]["leave"])
        for i, (row, (p, q, cost, merged)) in enumerate(zip(rows, path, strict=True)):
            middle = () if merged else BETWEEN[p, q]
            opened = not (rows[0]["first"] and i == 0)
            if merged:
                text = "\n\n" + clean(row["text"])
            else:
                text = "<|im_end|>\n" * opened + "".join(f"<|im_start|>{NAMES[r]}\n<|im_end|>\n" for r in middle) + f"<|im_start|>{NAMES[q]}\n" + clean(row["text"])
            if rows[0]["last"] and i + 1 == len(rows):
                text += "<|im_end|>\n"
            action = ("merge" if merged else "keep") if role_of(row["role"]) == q else "merge_relabel" if merged else "relabel"
            held.append((conv, row["turn"], row["role"], NAMES[q], action, ",".join(NAMES[r] for r in middle), cost, text))
        if len(held) >= 2000:
            yield flush()
            held.clear()
    if held:
        yield flush()


def repair(turns: DataFrame) -> DataFrame:
    """One row for each turn; the rendered pieces of a conversation, in turn order, are its repaired text, the costs add up to the least cost."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), "tie": F.monotonically_increasing_id()})
    turns = place(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("tie")], "pos").drop("conv", "tie")
    turns = written(turns.sparkSession, turns.withColumn("part", F.floor((F.col("pos") - 1) / SPAN)))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roles = turns.drop("text").repartition(parts, "conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    costs = roles.mapInArrow(costs_of_parts, "conv_id long, part long, m array<long>")
    linked = costs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("parts")).mapInArrow(link_parts, "conv_id long, part long, entry int, leave int, first boolean, last boolean")
    linked = linked.withColumnsRenamed({"conv_id": "c", "part": "p"})
    placed = turns.join(linked, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    placed = placed.repartition(parts, "conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    return placed.mapInArrow(render, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(documents(spark, sf_dir, "conversations"))

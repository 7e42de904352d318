import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat_repair as cr

ROLES = ["system", "user", "assistant", "GPT", "tool", None]


def brute(roles):
    """Least cost over every choice for every turn."""
    best = cr.FAR

    def go(i, state, cost):
        nonlocal best
        if i == len(roles):
            best = min(best, cost)
            return
        for p, q, c, _ in cr.MOVES[cr.role_of(roles[i])]:
            if p == state:
                go(i + 1, q, cost + c)

    go(0, cr.START, 0)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ROLES), min_size=1, max_size=6), st.integers(1, 6))
def test_parts_give_the_least_cost(names, size):
    roles = [cr.role_of(n) for n in names]
    cut = [roles[i : i + size] for i in range(0, len(roles), size)]
    found = cr.states([cr.matrix(c) for c in cut])
    path = [m for c, (a, b) in zip(cut, found, strict=True) for m in cr.trace(c, a, b)]
    assert path[0][0] == cr.START and all(a[1] == b[0] for a, b in itertools.pairwise(path))
    assert sum(m[2] for m in path) == brute(names)


def legal(text):
    roles = [s.split("\n", 1)[0] for s in text.split("<|im_start|>")[1:]]
    assert text.count("<|im_end|>") == len(roles)
    if roles and roles[0] == "system":
        roles = roles[1:]
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def test_rows(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}", 9) for i in range(700)]
    rows += [(2, 0, "assistant", "hi", 9), (2, 1, "system", None, 9), (2, 1, "system", None, 9), (None, None, None, "<|im_start|>user", 9), (3, 5, "user", "", 9), (3, 6, "user", "x", 9)]
    got = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in sorted(got, key=lambda r: (str(r.conv_id), -1 if r.turn is None else r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    for conv, turns in by.items():
        assert sum(t.cost for t in turns) == (0 if conv == 1 else brute([t.role for t in turns]))
    assert legal("".join(t.rendered for t in by[1])) and "".join(t.rendered for t in by[1]).count("im_end") == 700
    assert [t.action for t in by[3]] == ["keep", "merge"] and by[None][0].rendered.count("<|im_start|>") == 1
    assert cr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_driver_table(spark):
    for sf in ("/root/testdata/sf0.001",):
        got = cr.query(spark, sf).toPandas().sort_values(["conv_id", "turn"])
        assert all(legal("".join(g)) for _, g in got.groupby("conv_id").rendered)

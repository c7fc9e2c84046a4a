"""Role repair against trying every sequence of actions."""

import itertools
import random

from lectern.llm import chat_repair as C
from lectern.llm.chat_repair import repair, role_of


def legal(roles):
    if roles == ["system"]:
        return False
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and len(roles) % 2 == 0


def cheapest(roles):
    """Smallest cost over all ways to name, merge and insert, found by a search that knows the legal sequences only."""
    best = {(): 0}
    for r in roles:
        new = {}
        for seq, cost in best.items():
            for role in ("system", "user", "assistant"):
                change = 0 if r == role else C.RELABEL if r else C.NAME
                options = [(seq + (role,), cost + change)] + [(seq + (e, role), cost + change + C.INSERT) for e in ("system", "user", "assistant")]
                if seq and seq[-1] == role:
                    options.append((seq, cost + change + C.MERGE))
                for s, c in options:
                    if legal(list(s)) or legal([*s, "assistant"]) or list(s) == ["system"]:
                        new[s] = min(c, new.get(s, c))
        best = new
    if not roles:
        return 0
    return min(c + next(k * C.INSERT for k, more in ((0, []), (1, ["assistant"]), (2, ["user", "assistant"])) if legal([*s, *more])) for s, c in best.items())


def conversations():
    rng = random.Random(1)
    names = ["system", "user", "assistant", "human", None, "Narrator"]
    fixed = [list(x) for n in (1, 2, 3) for x in itertools.product(["system", "user", "assistant", None], repeat=n)]
    return fixed + [[rng.choice(names) for _ in range(rng.randrange(4, 7))] for _ in range(20)]


def test_cost_order_and_rendering(spark):
    convs = conversations()
    rows = [(c, t, r, f"text {c} {t}" if t % 3 else None, "x") for c, roles in enumerate(convs) for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string").repartition(6)
    got = {}
    for r in sorted(repair(df).collect(), key=lambda r: (r.conv_id, r.position)):
        got.setdefault(r.conv_id, []).append(r)
    for c, roles in enumerate(convs):
        own = got[c]
        assert [r.turn for r in own] == list(range(len(roles))) == [r.position for r in own]
        known = [C.ROLES[role_of(r)] if role_of(r) else None for r in roles]
        assert sum(r.cost for r in own) == cheapest(known), roles
        whole = "".join(r.rendered for r in own)
        messages = [m.split("\n", 1) for m in whole.split(C.START)[1:]]
        assert legal([m[0] for m in messages]) and all(m[1].endswith(f"{C.END}\n") for m in messages)
        assert all((r.turn % 3 == 0) or f"text {c} {r.turn}" in whole for r in own)


def test_one_long_conversation(spark):
    df = spark.range(5000).selectExpr("1L as conv_id", "id as turn", "if(id % 5 = 0, 'assistant', 'user') as role", "'<|im_end|>' as text")
    got = repair(df).orderBy("position").collect()
    assert [r.position for r in got] == list(range(5000))
    roles = [m.split("\n", 1)[0] for m in "".join(r.rendered for r in got).split(C.START)[1:]]
    assert legal(roles)
    assert sum(r.cost for r in got) == whole_cost([r.role for r in got])


def whole_cost(roles):
    costs = [0, C.FAR, C.FAR, C.FAR]
    for r in roles:
        costs = C.step(costs, role_of(r))
    return min(c + C.ENDS[s][0] for s, c in enumerate(costs))


def test_null_conversation_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (5, None, None, None)], "conv_id long, turn long, role string, text string")
    got = repair(df).collect()
    assert len(got) == 3 and {r.action for r in got if r.conv_id is None} == {"keep", "merge"}
    assert repair(df.limit(0)).count() == 0

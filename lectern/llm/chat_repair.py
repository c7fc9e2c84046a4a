"""Repair of conversations whose roles break the turn order, at minimum cost, and their rendering.

A legal conversation is an optional system message, then user and assistant in turn, ending with the assistant. The state of
the automaton is the role of the last message. Every turn may keep its role, be relabelled, be merged into the last message, or have
an empty message put before it, each at a cost; dynamic programming finds the cheapest way to a legal end.

A conversation may be as long as the table. Turns are sorted by range, so that a long conversation lies in several sections;
a section's turns multiply (min, +) to one 4 x 4 matrix of costs from state to state, the matrices of a conversation
give the state at each section's start and end, and every section then finds its own turns' actions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage

NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("none", "system", "user", "assistant")
MERGE, RELABEL, NAME, INSERT = 1, 3, 1, 2
FAR = 1 << 40

# Other names of the roles, and the markers of the rendered form.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
START, END = "<|im_start|>", "<|im_end|>"
LEGAL = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}

Action = tuple[int, str, tuple[int, ...]]


def role_of(name: str | None) -> int:
    """The number of a role; 0 for null and for unknown names, which any role may be given at a low cost."""
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else NONE


@cache
def moves(role: int) -> dict[tuple[int, int], Action]:
    """From state to state by one turn of this role: cost, action, roles of empty messages put before. Ties: keep, merge, insert."""
    out: dict[tuple[int, int], Action] = {}

    def offer(a: int, b: int, cost: int, action: str, before: tuple[int, ...] = ()) -> None:
        if (a, b) not in out or cost < out[a, b][0]:
            out[a, b] = (cost, action, before)

    for a in range(4):
        for b in range(1, 4):
            change = 0 if role == b else RELABEL if role else NAME
            name = "keep" if role == b else "relabel"
            if b in LEGAL[a]:
                offer(a, b, change, name)
            if a == b:
                offer(a, b, change + MERGE, "merge" if role == b else "relabel and merge")
            for empty in LEGAL[a]:
                if b in LEGAL[empty]:
                    offer(a, b, change + INSERT, f"insert, {name}", (empty,))
    return out


#: From a state to the end: cost and empty messages that are still needed.
ENDS: dict[int, tuple[int, tuple[int, ...]]] = {
    NONE: (0, ()), ASSISTANT: (0, ()), USER: (INSERT, (ASSISTANT,)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)),
}


def step(costs: list[int], role: int) -> list[int]:
    out = [FAR] * 4
    for (a, b), (cost, _, _) in moves(role).items():
        out[b] = min(out[b], costs[a] + cost)
    return out


def path(roles: list[int], start: int, end: int) -> list[Action]:
    """The actions of the cheapest way from state to state; of equally cheap ones that with the smaller states first from the end."""
    costs = [[0 if s == start else FAR for s in range(4)]]
    for r in roles:
        costs.append(step(costs[-1], r))
    out, state = [], end
    for i in range(len(roles) - 1, -1, -1):
        options = moves(roles[i])
        best = min((a for a in range(4) if (a, state) in options), key=lambda a: (costs[i][a] + options[a, state][0], a))  # noqa: B023
        out.append((*options[best, state][:2], options[best, state][2], state))
        state = best
    return out[::-1]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows with equal keys, which follow each other, as one list; at most a partition's share of a conversation."""
    key, rows = None, []
    for batch in batches:
        batch = batch[keys + columns].astype(object).where(batch[keys + columns].notna(), None)
        for values in batch.itertuples(index=False, name=None):
            if values[: len(keys)] != key:
                if rows:
                    yield key, rows
                key, rows = values[: len(keys)], []
            rows.append(values[len(keys) :])
    if rows:
        yield key, rows


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for (conv, worker), rows in _runs(batches, ["conv_id", "worker"], ["role"]):
        costs = [[0 if s == a else FAR for s in range(4)] for a in range(4)]
        for (role,) in rows:
            costs = [step(c, role_of(role)) for c in costs]
        out.append((conv, worker, len(rows), [min(c, FAR) for line in costs for c in line]))
    yield pd.DataFrame(out, columns=["conv_id", "worker", "n", "costs"]).astype({"conv_id": "Int64"})


def _borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for (conv,), rows in _runs(batches, ["conv_id"], ["worker", "n", "costs"]):
        best = [[0, FAR, FAR, FAR]]
        for _, _, m in rows:
            best.append([min(best[-1][a] + m[4 * a + b] for a in range(4)) for b in range(4)])
        state = min(range(4), key=lambda s: (best[-1][s] + ENDS[s][0], s))
        after, total = [], sum(n for _, n, _ in rows)
        for i in range(len(rows) - 1, -1, -1):
            worker, n, m = rows[i]
            before = min(range(4), key=lambda a: (best[i][a] + m[4 * a + state], a))  # noqa: B023
            total -= n
            after.append((conv, worker, before, state, total, i == len(rows) - 1))
            state = before
        out += after
    yield pd.DataFrame(out, columns=["conv_id", "worker", "enter", "leave", "before", "final"]).astype({"conv_id": "Int64"})


def shown(text: str | None) -> str:
    """Text as it is rendered: markers in it lose their meaning."""
    return (text or "").replace("<|", "< |")


def empty(role: int) -> str:
    return f"{START}{ROLES[role]}\n{END}\n"


RESULT = "conv_id long, position long, turn long, role string, new_role string, action string, inserted array<string>, cost int, rendered string"


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    columns = [x.split()[0] for x in RESULT.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64", "turn": "Int64"})
    for (conv, _, enter, leave, before, final), rows in _runs(
        batches, ["conv_id", "worker", "enter", "leave", "before", "final"], ["turn", "role", "text"]
    ):
        state = enter
        for i, ((turn, role, text), (cost, action, inserted, new)) in enumerate(
            zip(rows, path([role_of(r) for _, r, _ in rows], enter, leave), strict=True)
        ):
            if "merge" in action:
                body = "\n" + shown(text)
            else:
                body = (f"{END}\n" if state != NONE else "") + "".join(map(empty, inserted)) + f"{START}{ROLES[new]}\n{shown(text)}"
            added = [ROLES[x] for x in inserted]
            if final and i == len(rows) - 1:
                more, needed = ENDS[new]
                cost += more
                added += [ROLES[x] for x in needed]
                body += f"{END}\n" + "".join(map(empty, needed))
            out.append((conv, before + i, turn, role, ROLES[new], action, added, cost, body))
            state = new
        if len(out) > 5000:
            yield frame(out)
            out = []
    yield frame(out)


def repair(turns: DataFrame) -> DataFrame:
    """One row per turn with its new role, the action, the empty messages put before it (after it at the end), the cost, and its rendered text.

    The rendered texts of a conversation, joined in order of `position`, are the rendered conversation. Input: `conv_id`, `turn`, `role`,
    `text`; other columns are ignored. Turns are ordered by `turn`, then role and text, nulls first, and repeated rows are
    turns of their own. Rows with a null conv_id form one conversation; a null or unknown role is named at a low cost; a
    null text is empty; an empty table gives no rows.
    """
    order = ["conv_id", "turn", "role", "text"]
    ordered = cut_lineage(
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"worker": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    )
    by_section = ordered.select("conv_id", "worker", "at", "role").repartition("conv_id", "worker").sortWithinPartitions("conv_id", "worker", "at")
    sections = by_section.mapInPandas(_matrices, "conv_id long, worker int, n long, costs array<long>")
    borders = cut_lineage(
        sections.repartition("conv_id").sortWithinPartitions("conv_id", "worker")
        .mapInPandas(_borders, "conv_id long, worker int, enter int, leave int, before long, final boolean")
    )
    joined = ordered.join(borders.withColumnsRenamed({"conv_id": "c", "worker": "w"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("worker") == F.col("w")))
    return joined.repartition("conv_id", "worker").sortWithinPartitions("conv_id", "worker", "at").mapInPandas(_repair, RESULT)

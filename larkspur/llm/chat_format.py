"""Chat formatting with minimum-cost role repair.

Legal conversations have an optional system turn, then user and assistant turns in alternation, beginning with
the user and ending with the assistant. Each input turn may keep its role, take another (relabel), join the turn
before it (merge), or follow an inserted empty turn; dynamic programming over the automaton's states finds the
cheapest repair. The states are few, so a stretch of turns acts as a small min-plus matrix: conversations are cut
into stretches by turn number (and by rank, where many turns share a number), the matrices are chained per
conversation, and each stretch is then repaired between its given end states. No task needs a whole conversation's
turns, only the matrices; the rendered text of a conversation is one value.

Costs: merge 1, relabel 2, insert 3. Ties: the option listed first in OPTIONS.

Defined results: null or unknown roles (other than the known spellings in ROLES) must be relabelled; null text is
an empty turn; null turn numbers come first; turns with equal numbers are ordered by role and text; repeated rows are
turns of their own; a row with null conv_id is a conversation by itself. Extra columns are not read."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MERGE, RELABEL, INSERT = 1, 2, 3
STRETCH = 256
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Known spellings of roles.
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "model": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT}
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Which state may follow which.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


@lru_cache(None)
def options(state: int, role: int) -> tuple[tuple[int, int, bool, tuple[int, ...]], ...]:
    """(cost, next state, merged, inserted states) for a turn of the given role (0: unknown)."""
    found = []
    for to in (role, *[r for r in (USER, ASSISTANT, SYSTEM) if r != role]):
        if to == START:
            continue
        cost = 0 if to == role else RELABEL
        if to in LEGAL[state]:
            found.append((cost, to, False, ()))
        if to == state:
            found.append((cost + MERGE, to, True, ()))
        for between in LEGAL[state]:
            if to in LEGAL[between]:
                found.append((cost + INSERT, to, False, (between,)))
    best: dict[int, tuple] = {}
    for option in found:
        if option[1] not in best or option[0] < best[option[1]][0]:
            best[option[1]] = option
    return tuple(best.values())


@lru_cache(None)
def ending(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and inserted turns to end legally; a conversation without turns stays empty."""
    return {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}[state]


def forward(roles: list[int], start: int) -> list[list[int]]:
    """The least cost of each state after each turn."""
    costs = [[0 if s == start else FAR for s in range(4)]]
    for role in roles:
        now = [FAR] * 4
        for s, c in enumerate(costs[-1]):
            if c < FAR:
                for cost, to, _, _ in options(s, role):
                    now[to] = min(now[to], c + cost)
        costs.append(now)
    return costs


def repair(roles: list[int], start: int, end: int) -> list[tuple[int, int, bool, tuple[int, ...]]]:
    """The option chosen for each turn on a cheapest way from start to end."""
    costs, out, state = forward(roles, start), [], end
    for i in range(len(roles) - 1, -1, -1):
        s, option = next((s, o) for s in range(4) if costs[i][s] < FAR for o in options(s, roles[i]) if o[1] == state and costs[i][s] + o[0] == costs[i + 1][state])
        out.append(option)
        state = s
    return out[::-1]


def _role(role: str | None) -> int:
    return ROLES.get((role or "").strip().lower(), 0)


MATRIX = "array<bigint>"
CHAIN = "array<struct<seg:bigint,sub:bigint,a:int,b:int,cost:bigint,last:boolean>>"
PIECE = "struct<piece:string,turns:bigint,merged:bigint,relabelled:bigint,inserted:bigint>"


def _matrix(turns: pd.Series) -> pd.Series:
    """A stretch as 16 costs, from each state to each."""
    return pd.Series([[c for s in range(4) for c in forward([_role(t["role"]) for t in own], s)[-1]] for own in turns])


def _chain(stretches: pd.Series) -> pd.Series:
    """The states each stretch begins and ends with on a cheapest way through the conversation."""
    out = []
    for own in stretches:
        ways = [[0, FAR, FAR, FAR]]
        for x in own:
            m = x["m"]
            ways.append([min(ways[-1][s] + m[4 * s + t] for s in range(4)) for t in range(4)])
        total = min(ways[-1][s] + ending(s)[0] for s in range(4))
        state = next(s for s in range(4) if ways[-1][s] + ending(s)[0] == total)
        rows = []
        for i in range(len(own) - 1, -1, -1):
            m = own[i]["m"]
            before = next(s for s in range(4) if ways[i][s] + m[4 * s + state] == ways[i + 1][state])
            rows.append({"seg": own[i]["seg"], "sub": own[i]["sub"], "a": before, "b": state, "cost": total, "last": i == len(own) - 1})
            state = before
        out.append(rows[::-1])
    return pd.Series(out)


def _opened(state: int, first: bool) -> str:
    return ("" if first else "<|end|>\n") + f"<|{NAMES[state]}|>\n"


def _render(turns: pd.Series, a: pd.Series, b: pd.Series, last: pd.Series) -> pd.DataFrame:
    out = []
    for own, begin, end, final in zip(turns, a, b, last, strict=True):
        roles = [_role(t["role"]) for t in own]
        piece, state, n, merged, relabelled, inserted = [], int(begin), 0, 0, 0, 0
        for turn, role, (_, to, joins, between) in zip(own, roles, repair(roles, int(begin), int(end)), strict=True):
            for s in between:
                piece.append(_opened(s, state == START))
                state, n, inserted = s, n + 1, inserted + 1
            if joins:
                piece.append("\n\n")
                merged += 1
            else:
                piece.append(_opened(to, state == START))
                n += 1
            piece.append(turn["text"] or "")
            relabelled += to != role
            state = to
        if final:
            for s in ending(state)[1]:
                piece.append(_opened(s, state == START))
                state, n, inserted = s, n + 1, inserted + 1
            piece.append("<|end|>\n")
        out.append(("".join(piece), n, merged, relabelled, inserted))
    return pd.DataFrame(out, columns=["piece", "turns", "merged", "relabelled", "inserted"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to one row per conversation: conv_id, rendered, n_in, n_out, cost,
    n_merged, n_relabelled, n_inserted. A turn is rendered as `<|role|>`, a newline, its text and `<|end|>`."""
    matrix, chain, render = F.pandas_udf(_matrix, MATRIX), F.pandas_udf(_chain, CHAIN), F.pandas_udf(_render, PIECE)
    turns = conversations.select(F.col("conv_id").cast("bigint"), F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 62))).alias("turn"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text")
    seg = F.floor(F.col("turn") / STRETCH).cast("bigint")
    rank = F.row_number().over(Window.partitionBy("conv_id", "seg").orderBy("turn", "role", "text"))
    ranked = turns.where("conv_id is not null").withColumn("seg", seg).withColumn("sub", F.floor((rank - 1) / STRETCH).cast("bigint"))
    stretch = ranked.groupBy("conv_id", "seg", "sub").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    costs = matrix(F.transform("turns", lambda t: F.struct(t["role"].alias("role")))).alias("m")
    light = stretch.select("conv_id", "seg", "sub", costs)
    chained = light.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "sub", "m"))).alias("own")).select("conv_id", F.explode(chain("own")).alias("c")).select("conv_id", "c.*")
    pieces = stretch.join(chained, ["conv_id", "seg", "sub"]).select("conv_id", "seg", "sub", "cost", F.size("turns").alias("n_in"), render("turns", "a", "b", "last").alias("r"))
    whole = pieces.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "sub", "r.piece"))), lambda x: x["piece"]), "").alias("rendered"),
        F.sum("n_in").alias("n_in"), F.sum("r.turns").alias("n_out"), F.max("cost").alias("cost"), F.sum("r.merged").alias("n_merged"), F.sum("r.relabelled").alias("n_relabelled"), F.sum("r.inserted").alias("n_inserted"),
    )
    # Rows without a conversation stand alone: nothing is brought together for them.
    alone = turns.where("conv_id is null").select("conv_id", F.array(turn).alias("turns"))
    alone = alone.select("conv_id", "turns", costs).select("conv_id", "turns", chain(F.array(F.struct(F.lit(0).cast("bigint").alias("seg"), F.lit(0).cast("bigint").alias("sub"), "m")))[0].alias("c"))
    alone = alone.select("conv_id", "c.cost", render("turns", "c.a", "c.b", "c.last").alias("r"))
    return whole.union(alone.select("conv_id", "r.piece", F.lit(1).cast("bigint"), "r.turns", "cost", "r.merged", "r.relabelled", "r.inserted"))

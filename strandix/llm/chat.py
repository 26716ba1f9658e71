"""Operator 9, chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering.

Legal conversations are an optional system turn, then user and assistant turns by turns, user first, assistant last. A conversation's turns
pass through a dynamic program over the automaton's states; for each turn it may keep it, relabel it, or merge it into the turn before, and
anywhere it may insert an empty turn. The least total cost wins; of equal costs the first in the order keep, merge, relabel, insert. The plan
depends on the sequence of roles only, so each distinct sequence is solved once per worker. One shuffle by conversation brings turns together.

A conversation of over ``most_turns`` turns is never in one place. Such turns are sorted over all partitions, and each partition's part of a conversation
gives the least cost from every state it may begin in to every state it may end in: sixteen numbers. Those matrices, multiplied in order, tell in which
states the least-cost plan passes from part to part, and then the parts are solved and rendered on their own. They are rows of one
conv_id with ascending ``part``, whose renderings one after another are the conversation's; of plans of equal cost another may win.

Costs: relabel 2 (an unknown or null role 1), merge 1 between turns of one role and 3 otherwise, insert an empty turn 3, each system turn
relabelled to another role 4.

Cases: turns are ordered by turn, nulls last, then role and text; a null text is empty text; repeated rows are turns of their own; each row without
conv_id is a conversation of its own; an empty table gives no rows; a conversation always has at least its user and assistant turn after repair; other
columns are ignored. Markers of the template within a text are kept as text with their bar doubled, so they can't end a turn.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import cut, table

ROLES = ("system", "user", "assistant")
#: state -> roles that may follow; a state is the last turn's role, "" the start.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
INSERT, MERGE_SAME, MERGE_OTHER, RELABEL, RELABEL_UNKNOWN, RELABEL_SYSTEM = 3, 1, 3, 2, 1, 4


def relabel_cost(role: str, to: str) -> int:
    return 0 if role == to else RELABEL_UNKNOWN if role not in ROLES else RELABEL_SYSTEM if role == "system" else RELABEL


#: Turns of a conversation up to which it is one row.
MOST_TURNS = 100_000
STATES = ("", *ROLES)
SCHEMA = "conv_id bigint, part int, cost bigint, roles array<string>, n_turns int, n_merged int, n_relabelled int, n_inserted int, rendered string"
Best = dict[str, tuple[int, tuple]]


def _insertions(best: Best, plans: bool = True) -> Best:
    for _ in range(3):
        for state in list(best):
            cost, plan = best[state]
            for role in NEXT[state]:
                if role != "system" and (role not in best or best[role][0] > cost + INSERT):
                    best[role] = (cost + INSERT, (("new", role, None), plan) if plans else ())
    return best


def _step(best: Best, i: int, role: str, plans: bool = True) -> Best:
    """The best costs and plans by state after turn i. best[state] = (cost, plan); a plan is a chain (turn or merge, rest) to share tails."""
    after: Best = {}
    for rank in ("keep", "merge", "relabel"):
        for state in STATES:
            if state not in best:
                continue
            cost, plan = best[state]
            if rank == "merge":
                # The turn before has a role of the automaton; an inserted one takes a merge like any other.
                options = [(state, cost + (MERGE_SAME if role == state else MERGE_OTHER), ("merge", state, i))] if state else []
            else:
                options = [(to, cost + relabel_cost(role, to), ("new", to, i)) for to in NEXT[state] if (to == role) == (rank == "keep")]
            for to, c, step in options:
                if to not in after or c < after[to][0]:
                    after[to] = (c, (step, plan) if plans else ())
    return _insertions(after, plans)


def solve(roles: Iterable[str], start: str = "", end: str = "assistant") -> tuple[int, list[tuple[str, str, int | None]]]:
    """(cost, steps) of the least-cost plan from one state to another; a step is (new or merge, role, number of the turn or None)."""
    best = _insertions({"": (0, ())}) if start == "" else {start: (0, ())}
    for i, role in enumerate(roles):
        best = _step(best, i, role)
    cost, plan = best[end]
    steps = []
    while plan:
        steps.append(plan[0])
        plan = plan[1]
    return cost, steps[::-1]


@lru_cache(maxsize=200_000)
def repair(roles: tuple[str, ...]) -> tuple[int, tuple[tuple[str, tuple[int, ...]], ...]]:
    """(cost, repaired turns as (role, numbers of the turns merged in it)); an inserted turn has none."""
    cost, steps = solve(roles)
    out: list[list] = []
    for kind, role, i in steps:
        if kind == "new":
            out.append([role, [] if i is None else [i]])
        else:
            out[-1][1].append(i)
    return cost, tuple((r, tuple(m)) for r, m in out)


def _escaped(text: str) -> str:
    return text.replace("<|", "<||")


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{_escaped(text)}<|end|>\n" for role, text in turns)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = ("conv_id", "part", "cost", "roles", "n_turns", "n_merged", "n_relabelled", "n_inserted", "rendered")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)


def _runs(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[tuple[int, list[list]]]:
    """(conv_id, columns) of each conversation's part in one partition, whose rows come in order."""
    conv, held = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or row[0] != conv:
                if held is not None:
                    yield conv, held
                conv, held = row[0], [[] for _ in range(fields)]
            for column, x in zip(held, row[1:]):
                column.append(x)
    if held is not None:
        yield conv, held


def _long(turns: DataFrame) -> DataFrame:
    """turns(conv_id, t) of conversations that are too long for one place."""
    parts = max(2, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written with the number of its partition, so that both passes see the same parts in the same order.
    ordered = cut(turns.repartitionByRange(parts, "conv_id", "t").sortWithinPartitions("conv_id", "t").select("conv_id", F.col("t.role").alias("role"), F.col("t.text").alias("text"), F.spark_partition_id().alias("p")))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, (roles, p) in _runs(batches, 2):
            matrix = []
            for start in STATES:
                best = _insertions({"": (0, ())}, False) if start == "" else {start: (0, ())}
                for role in roles:
                    best = _step(best, 0, role, False)
                matrix += [best[end][0] if end in best else None for end in STATES]
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([p[0]], pa.int32()), pa.array([matrix], pa.list_(pa.int64()))], ["conv_id", "p", "matrix"])

    # No more rows than partitions and long conversations together.
    by_conv: dict[int, list[tuple[int, list]]] = {}
    for r in ordered.select("conv_id", "role", "p").mapInArrow(costs, "conv_id bigint, p int, matrix array<bigint>").collect():
        by_conv.setdefault(r.conv_id, []).append((r.p, r.matrix))
    legs: dict[tuple[int, int], tuple[int, str, str, int, bool]] = {}
    for conv, matrices in by_conv.items():
        matrices.sort()
        best: dict[str, int] = {"": 0}
        came: list[dict[str, str]] = []
        for _, m in matrices:
            after: dict[str, int] = {}
            frm: dict[str, str] = {}
            for i, s in enumerate(STATES):
                for j, e in enumerate(STATES):
                    if s in best and m[4 * i + j] is not None and (e not in after or best[s] + m[4 * i + j] < after[e]):
                        after[e], frm[e] = best[s] + m[4 * i + j], s
            best = after
            came.append(frm)
        end = "assistant"
        for k in range(len(matrices) - 1, -1, -1):
            start = came[k][end]
            legs[conv, matrices[k][0]] = (k, start, end, best["assistant"], k == len(matrices) - 1)
            end = start
    shared = turns.sparkSession.sparkContext.broadcast(legs)

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, (roles, texts, p) in _runs(batches, 3):
            part, start, end, cost, last = shared.value[conv, p[0]]
            out, names, merged, relabelled, inserted = [], [], 0, 0, 0
            # A turn is ended by what follows it, since its next part may still be merged into it.
            opened = part > 0
            for kind, role, i in solve(roles, start, end)[1]:
                if kind == "new":
                    out.append(("<|end|>\n" if opened else "") + f"<|{role}|>\n" + ("" if i is None else _escaped(texts[i])))
                    names.append(role)
                    inserted += i is None
                    relabelled += i is not None and roles[i] != role
                else:
                    out.append("\n" + _escaped(texts[i]))
                    merged += 1
                opened = True
            yield _batch([(conv, part, cost, names, len(names), merged, relabelled, inserted, "".join(out) + ("<|end|>\n" if last else ""))])

    return ordered.select("conv_id", "role", "text", "p").mapInArrow(rendered, SCHEMA)


def format_chats(conversations: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """(conv_id, part, cost, roles, n_turns, n_merged, n_relabelled, n_inserted, rendered) of every conversation: one row with part 0, or the parts of a long one; cost is the whole's, the other numbers are the part's."""
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").isNull().alias("last"), F.col("turn").cast("bigint").alias("turn"), F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit("")))).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    named = turns.where("conv_id IS NOT NULL")
    many = cut(named.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most_turns).select("conv_id"))
    n_many = many.count()
    if n_many:
        # As many as the turns by most_turns at most.
        many = F.broadcast(many) if n_many <= 100_000 else many
        long, named = named.join(many, "conv_id", "left_semi"), named.join(many, "conv_id", "left_anti")
    grouped = named.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    grouped = grouped.unionAll(turns.where("conv_id IS NULL").select("conv_id", F.array("t").alias("t"))).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                cost, plan = repair(tuple(roles))
                kept = sum(bool(m) for _, m in plan)
                rows.append((
                    conv, 0, cost, [r for r, _ in plan], len(plan), len(roles) - kept, sum(roles[m[0]] != r for r, m in plan if m), len(plan) - kept,
                    render([(r, "\n".join(texts[i] for i in m)) for r, m in plan]),
                ))
            yield _batch(rows)

    whole = grouped.mapInArrow(run, SCHEMA)
    return whole.unionAll(_long(long)) if n_many else whole


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))

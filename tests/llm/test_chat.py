import heapq
import itertools
import random

from strandix.llm import chat
from strandix.llm.chat import NEXT, ROLES, format_chats, relabel_cost, render, repair


def shortest(roles):
    """Dijkstra over (turns read, last role)."""
    heap, done = [(0, 0, "")], set()
    while heap:
        c, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(roles) and s == "assistant":
            return c
        for r in NEXT[s]:
            if r != "system":
                heapq.heappush(heap, (c + chat.INSERT, i, r))
            if i < len(roles):
                heapq.heappush(heap, (c + relabel_cost(roles[i], r), i + 1, r))
        if s and i < len(roles):
            heapq.heappush(heap, (c + (chat.MERGE_SAME if roles[i] == s else chat.MERGE_OTHER), i + 1, s))


def test_cost_is_least_and_plans_are_legal():
    for n in range(6):
        for roles in itertools.product((*ROLES, "tool"), repeat=n):
            cost, plan = repair(roles)
            assert cost == shortest(roles), roles
            got = [r for r, _ in plan]
            assert got[-1] == "assistant" and all(b in NEXT[a] for a, b in zip(["", *got], got))
            assert [i for _, m in plan for i in m] == list(range(n))


def test_good_conversations_stay():
    roles = ("system", "user", "assistant", "user", "assistant")
    assert repair(roles) == (0, tuple((r, (i,)) for i, r in enumerate(roles)))


def test_frames(spark):
    rows = [
        (1, 1, "assistant", "b", 5), (1, 0, "user", "a", 5), (2, 0, "user", None, 5), (2, None, None, "c", 5), (3, 0, "user", "x", 5), (3, 0, "user", "x", 5),
        (None, 0, "SYSTEM ", "<|user|>", 5), (4, 0, "user", "l" * 200000, 5), (5, 0, "", "", 5),
    ]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")).collect()}
    assert got[1].rendered == render([("user", "a"), ("assistant", "b")]) and got[1].cost == 0
    assert got[2].roles == ["user", "assistant"] and got[2].cost == 1
    assert got[3].rendered == render([("user", "x"), ("assistant", "x")]) and (got[3].cost, got[3].n_merged, got[3].n_relabelled) == (2, 0, 1)
    assert all(r.part == 0 for r in got.values())
    assert got[None].roles == ["system", "user", "assistant"] and "<||user|>" in got[None].rendered and got[None].n_inserted == 2
    assert got[4].n_inserted == 1 and len(got[4].rendered) > 200000
    assert got[5].n_turns == 2
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rows_without_a_conversation_are_their_own(spark):
    rows = [(None, 0, "user", f"t{i}") for i in range(300)]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), most_turns=10).collect()
    assert sorted(r.rendered for r in got) == sorted(render([("user", f"t{i}"), ("assistant", "")]) for i in range(300))


def parsed(text):
    """Turns of a rendering, as (role, text)."""
    out = []
    for piece in text.split("<|end|>\n")[:-1]:
        head, _, body = piece.partition("|>\n")
        assert head.startswith("<|")
        out.append((head[2:], body))
    return out


def test_long_conversations_are_repaired_in_parts(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(6):
        n = [700, 1, 31, 30, 1500, 5][conv]
        rows += [(conv, i if rng.random() < 0.98 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), f"{conv}/{i}<|x") for i in range(n)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = {r.conv_id: r for r in format_chats(frame).collect()}
    got = {}
    for r in format_chats(frame, most_turns=30).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(want) and len(got[4]) > 2 and len(got[3]) == 1
    for conv, parts in got.items():
        parts.sort(key=lambda r: r.part)
        assert [r.part for r in parts] == list(range(len(parts))) and {r.cost for r in parts} == {want[conv].cost}
        turns = parsed("".join(r.rendered for r in parts))
        roles = [r for r, _ in turns]
        assert roles == [x for r in parts for x in r.roles] and roles[-1] == "assistant" and all(b in NEXT[a] for a, b in zip(["", *roles], roles))
        # All texts are there once and in order, and the numbers are of a plan of that cost.
        given = sorted((t is None, t or 0, (x or ""), y) for c, t, x, y in rows if c == conv)
        assert "\n".join(t for _, t in turns if t) == "\n".join(y.replace("<|", "<||") for *_, y in given)
        assert sum(r.n_turns - r.n_inserted + r.n_merged for r in parts) == len(given)
        if len(parts) == 1:
            assert parts[0] == want[conv]

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from slotforge.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, fault string, seq int"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, letters, turns) by a search over whole scripts, cheapest and least first; rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, out
        state = (at, roles[-1:] or "", len(roles) > 0)
        if state in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add(state)
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, letters + "I", at, roles + name[0], (*out, f"{name}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, letters + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role:
                    heapq.heappush(heap, (cost + more, letters + "K", at + 1, roles + role[0], (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, letters + "R", at + 1, roles + name[0], (*out, f"{name}:{text}")))
    raise AssertionError


def brute(rows):
    out, convs = {}, defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own, kind = convs[conv], zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [((turn is not None, turn or 0), "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, turns in convs.items():
        turns.sort()
        seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            solid = text.strip(SPACE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                counts[fault] += 1
        numbers = [t[1] for t, _, _ in turns if t[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, letters, kept = cheapest(marked)
        out[conv] = (gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def made(seed=3, convs=60, most=12):
    rng = random.Random(seed)
    texts = ["Fine.", "What?", "no end", " \t\n", "", None, "Yes! \n", "été. ", "a.b!c? d", "Fine."]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "ux"])
            rows.append((c, rng.choice([t, t, t + 1, None] if rng.random() < 0.3 else [t]), role, rng.choice(texts) if rng.random() < 0.5 else f"text {c} {t}.", "x", 1))
    return [*rows, *rows[:7], (None, 1, "user", "null id.", "x", 1), (None, None, None, None, None, None)]


def found(spark, rows, **options):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.conv_id: tuple(r)[1:] for r in repair.digest(repair.repair(repair.damage(turns), **options)).collect()}


@pytest.mark.parametrize("options", [{}, {"held": 3}, {"held_bytes": 40}, {"held": 0}])
def test_brute_force(spark, options):
    rows = made()
    assert found(spark, rows, **options) == brute(rows)


ROLES, FAULTS = ["system", "user", "assistant", "tool", ""], ["", "", "", "truncated", "blank", "duplicate"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(FAULTS)), max_size=9))
def test_edits_are_cheapest_and_least(turns):
    rows = [(r, str(i), f) for i, (r, f) in enumerate(turns)]
    conv = repair.Conversation(1)
    for role, text, fault in rows:
        conv.add(0, role, text, fault)
    edits = [e for e in conv.end() if e[2]]
    cost, letters, kept = cheapest(rows)
    assert (sum(e[8] for e in edits), "".join(e[2] for e in edits)) == (cost, letters)
    assert tuple(f"{e[5]}:{e[6]}" for e in edits if e[2] != "D") == kept
    assert [e[1] for e in edits] == list(range(len(edits)))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(FAULTS)), min_size=40, max_size=120))
def test_long_conversations_are_as_good(turns):
    rows = [(r, str(i), f) for i, (r, f) in enumerate(turns)]
    conv = repair.Conversation(1)
    for role, text, fault in rows:
        conv.add(0, role, text, fault)
    edits = [e for e in conv.end() if e[2]]
    assert (sum(e[8] for e in edits), "".join(e[2] for e in edits)) == cheapest(rows)[:2]


def test_a_step_costs_the_same_in_any_conversation():
    rng = random.Random(1)
    repair.step.cache_clear()
    live = repair.OPEN
    for _ in range(200_000):
        live, _, pointers = repair.step(live, rng.choice("suat"), rng.choice(FAULTS))
        assert repair._packed(pointers) < 1 << 24
    assert repair.step.cache_info().currsize < 5000


def test_a_giant_conversation_is_spilled(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{t}. " + "x" * rng.randrange(50), "x", 1) for t in range(6000)]
    rows += [(8, t, "user", "same.", "x", 1) for t in range(5000)]
    assert found(spark, rows) == found(spark, rows, held=10**6)


def test_repaired_turns_alternate(spark):
    turns = spark.createDataFrame(made(), SCHEMA)
    edits = repair.repair(repair.read(turns)).collect()
    kept = defaultdict(str)
    for e in sorted(edits, key=lambda e: (str(e.conv_id), e.seq)):
        if e.edit and e.edit != "D":
            kept[e.conv_id] += e.role[:1]
    assert kept and all(re.fullmatch("(s?(ua)+)?", k) for k in kept.values())


def test_one_shuffle(spark):
    turns = spark.createDataFrame(made(), SCHEMA)
    plan = repair.mark(repair.damage(turns))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_clashing_columns_and_empty_table(spark):
    rows = [(1, 0, "user", "a.", "t", 7, "z"), (1, 1, "assistant", "b.", "t", 7, "z")]
    named = "conv_id long, turn long, role string, text string, dropped string, kind int, nth string"
    turns = spark.createDataFrame(rows, named)
    plain = spark.createDataFrame([(*r[:4], "", 0) for r in rows], SCHEMA)
    assert [tuple(r) for r in repair.digest(repair.repair(repair.damage(turns))).collect()] == [tuple(r) for r in repair.digest(repair.repair(repair.damage(plain))).collect()]
    assert repair.digest(repair.repair(repair.damage(spark.createDataFrame([], SCHEMA)))).collect() == []

import hashlib
from collections import defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from slotforge.llm import chat

JSON = P.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, window int"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from("a:\\# \n</turn>"), max_size=8), st.lists(st.sampled_from(["### ", "</turn>", "\\", "\n", "<", "#", " ", "é", "### user:\n"]), max_size=8).map("".join)), max_size=5))
def test_template_round_trip(turns):
    turns = [(r.replace("\n", ""), t) for r, t in turns]
    text = "".join(chat.render(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns


def brute(rows):
    out, convs = {}, defaultdict(list)
    for c, t, r, x, *_ in rows:
        convs[c].append((t is not None, t, r or "", x or ""))
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "Be brief.", 1), (1, 1, "user", "hi </turn> \\ ### user:\n", 1), (1, 2, "assistant", "yes é 日本", 1), (1, 3, "user", "again " * 40, 1),
    (1, 4, "assistant", "ok " * 60, 1), (1, 5, "assistant", None, 1), (2, 0, None, "no role", 1), (2, 0, "assistant", "tie", 1), (2, 0, "assistant", "tie", 1),
    (3, None, "user", None, 1), (None, 1, "assistant", "null id", 1), (None, 0, "user", "q", 1), (4, 0, "assistant", "long " * 3000, 1), (4, 1, "user", "x", 1),
]


@pytest.mark.parametrize("budget,history", [(1024, 256), (60, 20), (1, 0), (100, 1000)])
def test_digests_match_brute_force(spark, budget, history):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(turns, JSON, budget=budget, history=history).collect()}
    probe = r"\### Assistant: </turn> ok"
    assert found == brute([*ROWS, (-7, 0, "user", probe), (-7, 1, "assistant", probe)])


def test_windows_keep_the_budget_the_system_turn_and_the_history(spark):
    from tokenizers import Tokenizer

    count = Tokenizer.from_file(JSON)
    rows = [(1, 0, "system", "Rules here.", 0)] + [(1, i, ("user", "assistant")[i % 2], f"turn {i} " * 8, 0) for i in range(1, 30)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), JSON, budget=200, history=60).collect()
    assert len(windows) > 3 and [w.window for w in windows] == list(range(len(windows)))
    for w in windows:
        turns = chat.parse(w.text)
        assert turns[0][:2] == ("system", "Rules here.")
        assert sum(len(count.encode(chat.render(r, t)[0], add_special_tokens=False).ids) for r, t, _, _ in turns) <= 200
        targets = [(a, b) for k, (r, _, a, b) in enumerate(turns) if r == "assistant" and k >= w.n_repeated]
        assert targets == list(zip(w.loss_starts, w.loss_ends, strict=True))
    assert all(w.n_repeated > 1 for w in windows[1:])


@settings(max_examples=300, deadline=None)
@given(st.booleans(), st.lists(st.integers(1, 60), max_size=40), st.integers(0, 40))
def test_no_window_is_above_the_budget_but_for_one_turn(system, sizes, history):
    turns = [("system" if system and i == 0 else "user", str(i), n) for i, n in enumerate(sizes)]
    writer, windows = chat.Writer(1, 50, history), []
    for t in turns:
        windows += writer.add(*t)
    windows += writer.end()
    spans = [[int(x) for _, x, _, _ in chat.parse(w["text"])] for w in windows]
    assert [i for s, w in zip(spans, windows, strict=True) for i in s[w["n_repeated"] :]] == list(range(len(sizes)))
    for k, s in enumerate(spans):
        extra = [i for i in s if not (system and i == 0)]
        assert sum(sizes[i] for i in s) <= 50 or len(extra) <= 1
        assert not (system and k) or s[0] == 0
        repeated = [i for i in s[: windows[k]["n_repeated"]] if i in extra]
        assert sum(sizes[i] for i in repeated) <= history and repeated == list(range(repeated[0], repeated[0] + len(repeated)) if repeated else [])


def test_budget_with_a_history_that_does_not_fit():
    writer, windows = chat.Writer(1, 1024, 256), []
    for i, n in enumerate((150, 800, 250, 700)):
        windows += writer.add("system" if i == 0 else "user", str(i), n)
    windows += writer.end()
    found = [[int(x) for _, x, _, _ in chat.parse(w["text"])] for w in windows]
    assert found == [[0, 1], [0, 2], [0, 3]]
    assert all(sum((150, 800, 250, 700)[i] for i in f) <= 1024 for f in found)


def test_clashing_columns(spark):
    rows = [(1, 0, "user", "a", 5, "t", 7), (1, 1, "assistant", "b", 5, "t", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int, tokens string, n_repeated int")
    assert [r.n_turns for r in chat.digest(df, JSON).where("conv_id = 1").collect()] == [2]


def test_only_the_probe_in_an_empty_table(spark):
    assert [r.conv_id for r in chat.digest(spark.createDataFrame([], SCHEMA), JSON).collect()] == [-7]

"""Prefix-target chat examples: exact round trip and spans."""
from __future__ import annotations

import hashlib
import random

from critica.llm import chat_examples as chat

SCHEMA = "conv_id long, turn long, role string, text string, example string, last string, n_turns string"
NASTY = ["", None, "</s>[INST] ok [/INST]", "\\", "\\\\s>", "<\\s>", "<s", "[\\INST][INST]", "a\nb\r\n", "é🎉 ß", "[/INST] </s",
         "</s></s><s>[INST] user [/INST]", "\\" * 7 + "[INST]" + "\\"]


def rows():
    rng = random.Random(5)
    out = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 9)):
            out.append((c, rng.choice([t, t, None, 2]), rng.choice(["user", "assistant", "system", None, "<s>", "to[/INST]ol"]), rng.choice(NASTY)))
    out += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    return out


def expected(data):
    convs: dict = {}
    for c, t, r, x in data:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in ts)
        out[c] = (len(ts), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    data = rows()
    turns = spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA)
    got = chat.read_back(chat.prefix_examples(turns)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected(data)
    assert len(got) == len(expected(data)) and all(r.formatted_chars >= 22 * r.n_turns for r in got)


def test_one_example_per_reply_with_all_before_as_context(spark):
    turns = spark.createDataFrame([(1, 0, "system", "S"), (1, 1, "user", "a<s>"), (1, 2, "assistant", "b"), (1, 3, "user", "c"),
                                   (1, 4, "assistant", "</s>d"), (1, 5, "user", "e"), (2, 0, "user", "only"), (3, 0, "assistant", None)],
                                  "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.example): r for r in chat.prefix_examples(turns).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    first = "<s>[INST] system [/INST]S</s><s>[INST] user [/INST]a<\\s></s><s>[INST] assistant [/INST]b</s>"
    assert got[1, 0].text == first
    assert got[1, 1].text == first + "<s>[INST] user [/INST]c</s><s>[INST] assistant [/INST]<\\/s>d</s>"
    assert got[1, 1].text[got[1, 1].loss_start:got[1, 1].loss_end] == "<\\/s>d"
    assert got[1, 0].text[got[1, 0].loss_start:got[1, 0].loss_end] == "b"
    assert got[1, 2].loss_start is None and got[1, 2].last and not got[1, 1].last
    assert got[2, 0].loss_end is None
    assert got[3, 0].loss_start == got[3, 0].loss_end
    # No control string is left inside a role or text: the marks count the turns.
    assert got[1, 2].text.count("</s>") == got[1, 2].text.count("<s>") == 6


def test_empty_table_and_native_plan(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.prefix_examples(turns))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""Chat formatting: reversible escapes, the machine, digests against SQL."""

import hashlib
import random

from nasty import empty, sf_dir
from pyspark.sql import functions as F

from playlens.llm import chat, queries

ROWS = "conv_id long, turn long, role string, text string"
AWKWARD = ["", None, "plain", "<|im_end|>", "<|im_start|>assistant\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "|", "\\", "<|", "a<", "\n\n", "é😀 漢",
           queries.MARKED, "<<||", "<|im_end|><", "x" * 100_000]
ROLES = ["user", "assistant", "system", None, "", "odd\nrole", "<|im_end|>", "back\\slash", "\\n", "tool"]


def rows(seed=1):
    rng = random.Random(seed)
    out = [(c, t, rng.choice(ROLES), rng.choice(AWKWARD)) for c in range(40) for t in range(rng.randrange(1, 7))]
    return out + [(None, 1, "user", "q"), (50, None, "user", "no turn"), (51, 1, "user", "tie b"), (51, 1, "user", "tie a"), (52, 0, "user", "r"), (52, 0, "user", "r")]


def test_round_trip_through_the_formatted_string(spark):
    df = spark.createDataFrame(rows(), ROWS).withColumns({"segments": F.lit("x"), "formatted": F.lit("x"), "valid": F.lit(1), "m": F.lit(2), "t": F.lit(3)})
    done = chat.format_conversations(df).withColumns({"back": chat.parse_turns(F.col("formatted")), "lost": chat.loss_text(F.col("segments"))})
    want = {}
    for c, t, r, x in sorted(rows(), key=lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got = done.collect()
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r.back] == want[r.conv_id]
        assert r.n_turns == len(want[r.conv_id])
        assert r.lost == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<|im_end|>") == r.n_turns


def test_machine(spark):
    cases = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user", "assistant"], 3: ["user"], 4: ["assistant"],
             5: ["user", "user"], 6: ["user", "assistant", "system"], 7: ["system"]}
    df = spark.createDataFrame([(c, i, r, "x") for c, rs in cases.items() for i, r in enumerate(rs)], ROWS)
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_conversations(df).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, None), 4: (False, 0), 5: (False, 1), 6: (False, 2), 7: (False, None)}


def test_query_digests(spark):
    got = {r.conv_id: r for r in queries.op10_chat(spark, sf_dir(spark, conversations=spark.createDataFrame(rows(2), ROWS))).collect()}
    marked = [("user", queries.MARKED), ("assistant", queries.MARKED)]
    assert got[-1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in marked).encode()).hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(queries.MARKED.encode()).hexdigest() and got[-1].loss_chars == len(queries.MARKED)
    assert got[-1].valid and len(got) == len({r[0] for r in rows(2)}) + 1
    only = queries.op10_chat(spark, sf_dir(spark, conversations=empty(spark, ROWS))).collect()
    assert [r.conv_id for r in only] == [-1]


def test_other_templates(spark):
    t = chat.Template(opening="<|begin|>", closing="<|end|>", loss_roles=("bot",), moves=(("start", "human", "human"), ("human", "bot", "bot")), accepting=("bot",))
    df = spark.createDataFrame([(1, 0, "human", "<|end|> hi"), (1, 1, "bot", "yo <|begin|>")], ROWS)
    r = chat.format_conversations(df, t).withColumn("back", chat.parse_turns(F.col("formatted"), t)).first()
    assert r.valid and [tuple(x) for x in r.back] == [("human", "<|end|> hi"), ("bot", "yo <|begin|>")]

import hashlib
import random

import pytest

from fundaflow.llm import chat, queries
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, Text string, `x.y` int"
PARTS = ["<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<", "\\", "|im_start|>", "s>", "[", "INST]", "\n", "a", "%", "%0A", "<\\s>", "<\\\\s>", "😀", "é"]


def words(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_awkward_texts(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(60):
        turns = [(t, rng.choice(["user", "assistant", "system", words(rng, 4)]), words(rng, rng.choice([0, 3, 40]))) for t in range(rng.randint(1, 6))]
        rows += [(conv, t, r, x, "clash", 1) for t, r, x in turns]
        want[conv] = turns
    rng.shuffle(rows)
    chats = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    read = {r.conv_id: r for r in chats.withColumn("back", chat.turns_back(F.col("formatted"))).collect()}
    digest = {r.conv_id: r for r in chat.digests(chats).collect()}
    for conv, turns in want.items():
        assert [(x.role, x.text) for x in read[conv].back] == [(r, x) for _, r, x in turns]
        assert "".join(s.text for s in read[conv].segments) == read[conv].formatted
        loss = "".join(x for _, r, x in turns if r == "assistant")
        d = digest[conv]
        assert (d.n_turns, d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(turns), len(loss), sha(loss), len(read[conv].formatted))
        assert d.turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        body = read[conv].formatted.replace("<|im_start|>", "").replace("<|im_end|>", "")
        assert not any(c in body for c in chat.Template().control)


def test_machine(spark):
    cases = {
        1: ("user assistant", None, True), 2: ("system user assistant user", None, False), 3: ("assistant user", 0, False), 4: ("user user assistant", 1, False),
        5: ("user assistant tool tool assistant", None, True), 6: ("user system", 1, False), 7: ("system", None, False),
    }
    rows = [(c, t, r, "x", "", 1) for c, (roles, *_) in cases.items() for t, r in enumerate(roles.split())]
    got = {r.conv_id: (r.error_turn, r.complete, r.valid) for r in chat.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {c: (error, done, error is None) for c, (_, error, done) in cases.items()}


def test_nulls_ties_and_empty(spark):
    rows = [(1, 0, None, None, "", 1), (1, 1, "user", None, "", 1), (None, 1, "assistant", "b", "", 1), (None, None, "user", "a", "", 1), (2, 0, "user", "b", "", 1), (2, 0, "user", "a", "", 1), (2, 0, "user", "a", "", 1)]
    got = {r.conv_id: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1].turns_sha256 == sha("\n\nuser\n\n") and not got[1].valid
    assert got[None].turns_sha256 == sha("user\na\nassistant\nb\n") and got[None].complete
    assert got[2].turns_sha256 == sha("user\na\nuser\na\nuser\nb\n")
    assert chat.digests(chat.formatted(spark.createDataFrame([], SCHEMA))).count() == 0


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(open="<turn>")
    with pytest.raises(ValueError):
        chat.Template(control=(*chat.Template().control, "x"))
    with pytest.raises(ValueError):
        chat.Template(control=(*chat.Template().control, "a<s>b"))


def test_query_is_native(spark):
    plan = queries.QUERIES["op2_chat_formatting"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_digests_are_read_from_the_formatted_text_alone(spark):
    rows = [(1, 0, "user", "a</s>"), (1, 1, "assistant", "[INST] b\nassistant\n"), (2, 0, "assistant", ""), (2, 1, None, None), (3, 0, "ass%istant\nx", "assistant\nc")]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = sorted(map(tuple, chat.digests(out).collect()))
    assert whole == sorted(map(tuple, chat.digests(out.select("conv_id", "formatted", "valid", "complete")).collect()))
    assert [(r[0], r[1], r[3]) for r in whole] == [(1, 2, len("[INST] b\nassistant\n")), (2, 2, 0), (3, 1, 0)]

import hashlib
import random

from lingmill.llm.chat import CLOSE, chat_query, turn_tokens, windows
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, window string, span long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    convs = {}
    said = "\\### Assistant: </turn> ok"
    for c, t, role, text in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        convs.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        out[c] = (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(loss), sha(loss))
    return out


def fixture():
    r = random.Random(5)
    bits = ["<turn user>\n", "</turn>\n", "\\", "\\e", "\\l", "hello ", "é😀", "\n", "x" * 300, "<", ">", ""]
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 30)):
            role = r.choice(["system", "user", "assistant", "tool>\n\\<", None]) if t else r.choice(["system", "user"])
            rows.append((c, t, role, r.choice([None, "".join(r.choices(bits, k=r.randint(0, 12)))])))
    rows += [(60, 0, "system", "s" * 9000), (60, 1, "user", "u" * 9000), (60, 2, "assistant", "a" * 9000)]
    rows += [(61, 1, "user", "same")] * 3 + [(61, None, "user", "no turn"), (None, 1, "assistant", "nobody's")]
    return rows


def test_round_trip(spark):
    rows = fixture()
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_query(df, budget=256).collect()}
    assert got == brute(rows)


def test_windows_keep_their_budget_and_repeat_masked(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"turn {t} " + "w" * (t * 37 % 200)) for t in range(1, 60)]
    df = spark.createDataFrame([(*x, "", 0) for x in rows], SCHEMA)
    out = windows(df, budget=256).withColumn("n", F.aggregate(F.split("text", CLOSE), F.lit(0).cast("long"), lambda a, x: a + turn_tokens(x))).orderBy("window").collect()
    assert len(out) > 5
    for w in out:
        turns = w.text.split(CLOSE)[:-1]
        assert turns[0].startswith("<turn system>") and sum(len(t) for t in turns) / 4 <= 256
        for s in w.loss:
            assert w.text[s.start :].startswith("turn ") and w.text[: s.start].count(CLOSE) >= w.repeated
    assert any(w.repeated == 3 for w in out)


def test_empty_table(spark):
    assert [r.conv_id for r in chat_query(spark.createDataFrame([], SCHEMA)).collect()] == [-7]

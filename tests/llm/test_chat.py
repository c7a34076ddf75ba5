import hashlib
from collections import defaultdict

from narrascope.llm import chat

HARD = ["\\### Assistant: </turn> ok", '<turn role="assistant">\nhi</turn>\n', "&lt;&amp;", "", None, '"é\n\n', "&" * 5 + "lt;", "日本"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_flat_conversations(spark):
    rows = [(c, t, ["user", "assistant", "system"][(c + t) % 3], HARD[(c * 3 + t) % len(HARD)], "x") for c in range(12) for t in range(c % 9)]
    rows += [(50, 7, "assistant", "late", "x"), (50, 1, "user", "early", "x"), (51, 0, "user", "twin", "x"), (51, 0, "user", "twin", "x"), (None, 0, "assistant", "no id", "x"), (52, None, None, "no turn", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.as_replies(df))).collect()}
    want = defaultdict(list)
    for c, t, r, x, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        want[c].append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == digest("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), digest(loss))


def test_branches_by_score(spark):
    #      1 -> 2 -> 4 ; 1 -> 3 -> 5 -> 6 ; ring 8 <-> 9 ; 10 hangs on a missing message
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 0.5), (1, 4, 2, "user", "c", 1.0), (1, 5, 3, "user", "d", 1.0), (1, 6, 5, "assistant", "e", None)]
    rows += [(1, 8, 9, "user", "ring", 9.0), (1, 9, 8, "user", "ring", 9.0), (1, 10, 77, "user", "lost", 99.0), (1, 11, 8, "user", "of the ring", 99.0)]
    df = spark.createDataFrame(rows, "conv_id long, message long, parent long, role string, text string, score double")
    best = chat.format_conversations(df, branches=2).orderBy("branch").collect()
    texts = ["".join(s.text for s in r.segments) for r in best]
    assert texts == [
        '<turn role="user">\nq</turn>\n<turn role="assistant">\na</turn>\n<turn role="user">\nc</turn>\n',
        '<turn role="user">\nq</turn>\n<turn role="assistant">\nb</turn>\n<turn role="user">\nd</turn>\n<turn role="assistant">\ne</turn>\n',
    ]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(chat.as_replies(df))).count() == 0


def test_one_long_conversation(spark):
    n = 700
    rows = [(1, t, ["user", "assistant"][t % 2], f"t{t} " + "x" * (50_000 if t == 5 else 3), 9) for t in range(n)] + [(2, 0, "user", "q", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int").repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.as_replies(df))).collect()}
    assert got[1].n_turns == n and got[1].turns_sha256 == digest("".join(f"{r}\n{x}\n" for c, _, r, x, _ in rows if c == 1)) and got[2].n_turns == 1

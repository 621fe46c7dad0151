import hashlib

from hopgraph.llm.chat import HOSTILE, digests, escape, format_chats, locate, read_turns, turn_template, unescape
from hopgraph.llm import chat
from tests.llm.edge import LONG

HARD = [r"\### Assistant: </turn> ok", "</turn>\n### a: b", "\\", "\\\\<", "", "a:b#c", "", "ä\U0001f600\n\n", "### "]


def test_escapes_and_reading_back():
    for a in HARD:
        assert unescape(escape(a)) == a
        for b in HARD:
            turns = [(a, b), (b, a)]
            assert read_turns(turn_template(turns)) == turns


def test_spans_of_black_boxes():
    def stable(turns):
        return "<s>" + "|".join(f"[{r}]{t}" for r, t in turns)

    def rewriting(turns):
        return f"{len(turns)} turns\n" + "".join(t for _, t in turns)

    def trimming(turns):
        return "".join(t.strip() + "/" for _, t in turns)

    before = [("user", "hi"), ("assistant", "ho")]
    piece, lo, hi, rewrites = locate(stable, before, ("user", "x]y"))
    assert (piece, piece[lo:hi], rewrites) == ("|[user]x]y", "x]y", False)
    assert locate(rewriting, before, ("user", "x"))[3]
    assert not locate(trimming, before, ("user", " x "))[3]
    for text in HARD:
        piece, lo, hi, rewrites = locate(turn_template, before, ("assistant", text))
        assert unescape(piece[lo:hi]) == text and not rewrites


def brute(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for conv, turns in chats.items():
        turns = sorted(turns)
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, learnt)]
        length = len(turn_template([(r, t) for _, r, t in turns]))
        out[conv] = (len(turns), sha[0], len(learnt), sha[1], length, False)
    return out


def test_digests_against_brute_force(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    rows += [(2, 0, None, None), (2, None, "assistant", "x"), (2, 0, None, None), (None, 1, "user", "y"), (3, 0, "assistant", LONG)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(300)]
    rows += HOSTILE
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as piece")
    got = {r.conv_id: tuple(r)[1:] for r in digests(format_chats(chats)).collect()}
    assert got == brute(rows)
    assert digests(format_chats(chats.filter("turn > 1000"))).count() == 0


def test_rewriting_is_reported(spark):
    chats = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = format_chats(chats, lambda turns: f"{len(turns)}:" + "".join(t for _, t in turns)).collect()
    assert [r.rewrites for r in sorted(got, key=lambda r: r.pos)] == [False, True]


def test_long_conversations_are_rendered_whole(spark):
    def numbering(turns):
        return "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(turns))

    def alternating(turns):
        for i, (r, _) in enumerate(turns):
            if r != ("assistant" if i % 2 else "user"):
                raise ValueError("user first, then in turn")
        return "".join(f"[{r}]{t}" for r, t in turns)

    def forgetting(turns):
        return "".join(t + "/" for _, t in turns[len(turns) > 100 :])

    turns = [("assistant" if i % 2 else "user", f"text {i}") for i in range(151)]
    chats = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for template in (numbering, alternating, forgetting):
        got = sorted(format_chats(chats, template).collect(), key=lambda r: r.pos)
        assert [r.rewrites for r in got] == [template is forgetting and i == 100 for i in range(151)]
        if template is not forgetting:
            assert "".join(r.piece for r in got) == template(turns)
            assert all(r.piece[r.text_start : r.text_stop] == t for r, (_, t) in zip(got, turns))


def test_the_query_renders_all_turns_before(spark, monkeypatch, tmp_path):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(70)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    real, asked = format_chats, []
    monkeypatch.setattr(chat, "format_chats", lambda chats, **kw: asked.append(kw.get("history")) or real(chats, **kw))
    got = {r.conv_id: r for r in chat.op7_chat_format(spark, str(tmp_path)).collect()}
    assert asked == [None] and got[1].n_turns == 70
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in rows if r == "assistant").encode()).hexdigest()

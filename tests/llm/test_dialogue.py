"""Repairs against a search over all edits and a plain backward pass."""

import hashlib
import itertools
import random
import zlib

import pytest

from hopgraph.llm.dialogue import Repair, damaged, digests, op13_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """rows (role, text) in order -> first fault of each."""
    out, seen = [], set()
    for role, text in rows:
        solid = text.rstrip(SPACE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def legal(roles):
    text = "".join(roles).removeprefix("s")
    return not roles or (text != "" and text == "ua" * (len(text) // 2))


def enumerate_all(rows):
    """(cost, audit, repaired) by trying every sequence of edits with at most two insertions at a place."""
    best = None
    told = faults(rows)
    gaps = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        extra = sum(map(len, inserts))
        if extra > 2:
            continue
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, put, ok = 5 * extra, "", [], True
            for i in range(len(rows) + 1):
                for role in inserts[i]:
                    audit += "I"
                    put.append((role, ""))
                if i == len(rows):
                    break
                (role, text), e, fault = rows[i], edits[i], told[i]
                ok &= e == "D" or fault not in ("blank", "duplicate")
                cost += {"D": 2, "K": 0}.get(e, 1) + (5 if fault == "truncated" and e != "D" else 0)
                audit += e if e in "DK" else "R"
                if e != "D":
                    put.append((role if e == "K" else "user" if e == "u" else "assistant", text))
            if ok and legal([r[:1] or "x" for r, _ in put]) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in put))
    return best


def plain(rows):
    """The same by one backward pass that carries (cost, audit, what is put out) for each state."""
    told = faults(rows)
    done = {"": (0, "", ""), "a": (0, "", ""), "u": (5, "I", "\nassistant:"), "s": (10, "II", "\nuser:\nassistant:")}
    for (role, text), fault in zip(reversed(rows), reversed(told)):
        more = 5 if fault == "truncated" else 0
        new = {}
        for state in ("", "s", "u", "a"):
            want = "a" if state == "u" else "u"
            full = "assistant" if state == "u" else "user"
            options = [(done[state][0] + 2, "D" + done[state][1], done[state][2])]
            if fault not in ("blank", "duplicate"):
                c, a, r = done[want]
                options.append((c + 1 + more, "R" + a, f"\n{full}:{text}{r}"))
                if role[:1] == want:
                    options.append((c + more, "K" + a, f"\n{role}:{text}{r}"))
                if role[:1] == "s" and state == "":
                    c, a, r = done["s"]
                    options.append((c + more, "K" + a, f"\n{role}:{text}{r}"))
            new[state] = min(options)
        u, a = new["u"], new["a"]
        new["u"] = min(u, (a[0] + 5, "I" + a[1], "\nassistant:" + a[2]))
        new["a"] = min(a, (u[0] + 5, "I" + u[1], "\nuser:" + u[2]))
        for state in ("", "s"):
            c, x, r = new["u"]
            new[state] = min(new[state], (c + 5, "I" + x, "\nuser:" + r))
        done = new
    cost, audit, put = done[""]
    return cost, audit, put[1:]


def random_rows(rng, n):
    roles = ("user", "assistant", "system", "tool", "", "u")
    texts = ("Hi.", "Yes!", "what", "  ", "", "Why? \t", "ok .", "no")
    return [(rng.choice(roles if rng.random() < 0.4 else roles[:2]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(1000)}.") for _ in range(n)]


def run(spark, conversations, chunk):
    rows = [(c, t, *r) for c, rs in conversations.items() for t, r in enumerate(rs)]
    fixed = Repair(spark.createDataFrame(rows, SCHEMA).repartition(6), chunk)
    report = {r.conv_id: r for r in fixed.report().collect()}
    found = {r.conv_id: r for r in digests(fixed.edits()).collect()}
    return fixed, report, found


def test_plain_pass_is_that_of_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n < 3 else 25):
            rows = random_rows(rng, n)
            assert plain(rows) == enumerate_all(rows), rows


@pytest.mark.parametrize("chunk", [3, 64])
def test_chunks_give_the_plain_pass(spark, chunk):
    rng = random.Random(chunk)
    conversations = {i: random_rows(rng, rng.choice((1, 2, 5, 9, 40))) for i in range(60)}
    conversations[100] = random_rows(rng, 700)
    conversations[101] = [("system", f"s{i}.") for i in range(100)] + [("user", "q."), ("assistant", "a.")]
    conversations[102] = [("tool", "")] * 90  # nothing forgets where it began
    fixed, report, found = run(spark, conversations, chunk)
    assert fixed.passes > 1
    for conv, rows in conversations.items():
        cost, audit, put = plain(rows)
        told = faults(rows)
        r, f = report[conv], found[conv]
        assert (r.cost, f.audit) == (cost, audit), conv
        assert f.repaired_sha256 == hashlib.sha256(put.encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated) == tuple(told.count(k) for k in ("blank", "duplicate", "truncated"))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs) and r.gaps == 0


def test_edits_are_whole(spark):
    fixed, _, _ = run(spark, {1: [("system", "s."), ("tool", " "), ("user", "b.")]}, 2)
    got = [(r.edit, r.role, r.text) for r in fixed.edits().orderBy("rn", "step").collect()]
    assert got == [("R", "user", "s."), ("D", None, None), ("R", "assistant", "b.")]
    fixed, _, _ = run(spark, {1: [("user", "b."), ("user", "c"), ("user", "d.")], 2: [("assistant", "a."), ("user", "b.")]}, 2)
    got = [(r.edit, r.role, r.text) for r in fixed.edits().orderBy("rn", "step").collect()]
    assert got == [
        ("K", "user", "b."), ("D", None, None), ("R", "assistant", "d."), ("R", "user", "a."), ("R", "assistant", "b.")
    ]


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 4, None, None), (1, None, "assistant", "Yes."),
        (None, 1, "user", "x"), (None, None, "system", "be."), (2, None, None, None), (3, 7, "user", "long " * 50000 + "."),
        (4, 2, "assistant", "  .\x0b "), (5, 9, "user", "q?"), (5, 9, "assistant", "a!"),
    ]
    base = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rn", "2 as g", "3 as k", "4 as code", "5 as fault", "6 as _tie", "7 as audit")
    base.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op13_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5}
    for conv in got:
        left = []
        for c, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            n = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if n == 1 else text.translate(str.maketrans("", "", ".!?")) if n == 2 else text
            left += [(turn, "user" if n == 4 else role, text)] * {0: 0, 3: 2}.get(n, 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
        cost, audit, put = plain([r[1:] for r in left])
        r = got[conv]
        turns = [t for t, _, _ in left if t is not None]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(put.encode()).hexdigest())
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op13_repair(spark, f"{tmp_path}/none").count() == 0
    assert damaged(spark.createDataFrame([], SCHEMA)).count() == 0

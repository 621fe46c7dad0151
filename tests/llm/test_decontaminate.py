import re

from hopgraph.llm.decontaminate import contamination, drop_contaminated
from tests.llm.edge import LONG, documents, nothing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, width=10):
    out = {}
    wins = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + width]), set()).add(item)
    for doc, text in texts:
        w = plain_words(text)
        hit, ids = set(), set()
        for win, owners in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    ids |= owners
        out[doc] = (len(w), len(hit), sorted(ids))
    return out


ITEMS = [
    (10, "Quick, brown FOX"),
    (11, "the quick brown fox jumps over the lazy dog and runs away"),
    (12, None),
    (13, ""),
    (14, "--- ..."),
    (None, "one"),
    (15, "lazy dog"),
    (15, "lazy dog"),
    (16, "ünïcode Wörds"),
]


def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_brute_force(spark):
    texts = [
        (20, "A quick brown fox! jumps-over the lazy dog; and runs AWAY quick brown fox quick brown foxes"),
        (21, "unquick brown fox lazy\ndog"),
        (22, "x" * 50000 + " lazy dog"),
    ]
    docs = documents(spark, [(a, b, "en", "z", 1) for a, b in texts])
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination(docs, bench(spark)).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute([r for r in rows if r[1] != LONG], [i for i in ITEMS if i[0] is not None])
    for k, v in want.items():
        assert got[k] == v, k
    assert got[6] == (60000, 0, [])


def test_spans_lead_back_to_the_text(spark):
    text = "Ä  the Quick-brown, FOX; x lazy\n\ndog."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = contamination(docs, bench(spark)).first()
    raw = text.encode()
    assert [raw[s.start : s.stop].decode() for s in row.spans] == ["Quick-brown, FOX", "lazy\n\ndog"]


def test_several_automata_give_the_same(spark, monkeypatch):
    import hopgraph.llm.decontaminate as d

    docs = documents(spark)
    want = sorted(map(str, contamination(docs, bench(spark)).collect()))
    monkeypatch.setattr(d, "AUTOMATON_BYTES", 20)
    assert sorted(map(str, contamination(docs, bench(spark)).collect())) == want


def test_drop_and_empty_tables(spark):
    docs = documents(spark)
    kept = drop_contaminated(docs, bench(spark))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "5", "6", "8", "None"]
    assert contamination(nothing(spark), bench(spark)).count() == 0
    assert drop_contaminated(docs, bench(spark).filter("item_id = 0")).count() == docs.count()

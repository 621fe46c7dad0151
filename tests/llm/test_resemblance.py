"""Classes of near copies against a comparison of all pairs by their five-word shingles."""

import random

import corpus_pipeline
import hopgraph.llm.resemblance as resemblance
from hopgraph.llm.simhash import fingerprint
from tests.llm.edge import documents, nothing

SF = "/root/testdata/sf0.01"


def slow_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_classes(texts, least=0.8):
    sets = [slow_shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if k in (x, y) else k for k in label]
    return label


def test_stage_drops_texts_of_similarity_08(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for changed in (0, 1, 2, 3, 6, 9):  # of 100 words; each ends five shingles
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((n, " ".join(words)))
        for k in range(changed):
            words[5 + 10 * k] = f"x{rng.randrange(10**6)}"
        rows.append((n + 1, " ".join(words)))
        n += 2
    chain = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(4):  # each near the next, the ends far apart
        rows.append((n + k, " ".join(chain)))
        chain[10 + 20 * k] = chain[20 + 20 * k] = "y"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = slow_classes([t for _, t in rows])
    assert len(set(label)) == 3 + 6 + 1  # changed little, changed more, the chain
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {rows[i][0] for i in set(label)}


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    label = slow_classes([t for _, t in rows])
    got = {r.doc_id: r.component_id for r in resemblance.resembling(docs).collect()}
    assert got == {rows[i][0]: rows[k][0] for i, k in enumerate(label)}


def test_bands_of_many_classes(spark, monkeypatch):
    """Texts around the similarity: bands hold many classes, in several blocks."""
    monkeypatch.setattr(resemblance, "BLOCK", 8)
    monkeypatch.setattr(resemblance, "COLUMNS", 64)
    monkeypatch.setattr(resemblance, "STARS", 1)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(70):
        words = list(base)
        for k in rng.sample(range(5, 95), rng.choice((1, 2, 3, 4))):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    label = slow_classes([t for _, t in rows])
    assert 3 < len(set(label)) < 70
    got = {r.doc_id: r.component_id for r in resemblance.resembling(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: k for i, k in enumerate(label)}
    assert sum(got[i] == want[i] for i in got) == len(got)


def test_odd_rows(spark):
    docs = documents(spark)
    kept = resemblance.drop_resembling(docs)
    assert kept.columns == docs.columns
    sets = {slow_shingles(r.text) for r in docs.collect()}
    assert {slow_shingles(r.text) for r in kept.collect()} == sets and kept.count() == len(sets)
    assert resemblance.resembling(nothing(spark)).count() == 0
    assert resemblance.drop_resembling(nothing(spark)).count() == 0


def test_stage_links_simhash_classes(spark):
    """Texts of few shingles in common whose fingerprints agree, as one passage of both comes again and again."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(11)]
    rows = [(i, " ".join(passage * 80 + [word() for _ in range(30)])) for i in range(4)]
    rows += [(10, " ".join(word() for _ in range(100))), (11, None), (12, " ")]
    prints = [fingerprint((t or "").encode()) for _, t in rows]
    assert all((prints[0] ^ p).bit_count() <= 4 for p in prints[:4])
    label = slow_classes([t for _, t in rows])
    assert len(set(label[:4])) == 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {0, 10, 11}

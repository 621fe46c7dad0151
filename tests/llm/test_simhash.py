import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import hopgraph.llm.simhash as simhash
from tests.llm.edge import documents, nothing


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=4):
    """Smallest index reachable, by comparing all."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprints(spark):
    docs = documents(spark)
    got = [(r.doc_id, r.fp & (2**64 - 1)) for r in simhash.fingerprints(docs).collect()]
    want = [(r.doc_id, slow_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [1 << 21, 1 << 12, 1 << 8])
def test_links_find_every_class(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_VALUES", block)
    rng = random.Random(block)
    prints = {0, 2**64 - 1}
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
    dense = rng.getrandbits(64)
    prints |= {dense ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    work = simhash.Scratch(spark, "test")
    comp = simhash.components(simhash.links(df, len(prints)), work)
    got = {r.node: r.comp for r in comp.collect()}
    want = classes(prints)
    groups = {}
    for i, p in enumerate(signed):
        groups.setdefault(want[i], set()).add(p)
    mine = {}
    for p in signed:
        mine.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    assert all(min(v) == k for k, v in mine.items())


def test_documents_and_dropping(spark):
    docs = documents(spark)
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    ids = {k[0]: v for k, v in found.items()}
    assert ids[1] == ids[2] == 1 and ids[3] == ids[4] == ids[5] == 3 and ids[8] == 8 and ids[None] is None
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.drop_near_duplicates(nothing(spark)).count() == 0

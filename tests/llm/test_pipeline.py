"""The pipeline's stages against plain versions of them, each on the stage's own input."""

import corpus_pipeline
from hopgraph.llm.pack import public_paths
from tests.llm.edge import documents, nothing
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_pack import check
from tests.llm.test_resemblance import slow_classes

SF = "/root/testdata/sf0.001"


def later_copies_cut(rows, length=200):
    """Texts without what starts earlier, by (doc_id, start); only whole characters go."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        at, kept = 0, ""
        for c in text:
            n = len(c.encode())
            kept += "" if all(gone[at : at + n]) else c
            at += n
        out[doc] = kept
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    good = stages[0](spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    known = [i for i in labels if i in {r.doc_id for r in docs.collect()}]
    assert sum((i in kept) == bool(labels[i]) for i in known) >= 0.95 * len(known)

    one = stages[1](spark, good, SF).cache()
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    label = slow_classes([t for _, t in rows])
    assert {r.doc_id for r in one.collect()} == {rows[i][0] for i in set(label)}

    cut = stages[2](spark, one, SF).cache()
    want = later_copies_cut([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    clean = stages[3](spark, cut, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = windows(sorted(want.items()), items)
    assert {r.doc_id for r in clean.collect()} == {k for k, v in hits.items() if v[1] == 0}
    for df in (good, one, cut, clean):
        assert df.columns == columns

    packed = stages[4](spark, clean, SF).collect()
    check(packed, [(r.doc_id, r.text) for r in clean.collect()])
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed))
    assert public_paths()[0].endswith(".json")


def test_stages_bear_odd_rows(spark):
    for docs in (documents(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            new = stage(spark, docs, SF)
            assert new.columns == docs.columns, name
            assert new.count() <= docs.count()
            docs = new
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()

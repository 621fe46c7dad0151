import os

from hopgraph.operators.traverse import distances
from hopgraph.plans.scratch import Scratch, release, shared_dir
from tests import tiny


def test_release_leaves_nothing(spark):
    release(spark)
    tiny._CACHE.clear()
    folder = f"{shared_dir(spark)}/hopgraph"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = distances(tiny.graph(spark, "A"), tiny.ids(spark, 3)).collect()
    kept = Scratch(spark, "kept")
    kept.save(tiny.ids(spark, 1))
    assert len(got) == 11 and set(os.listdir(folder)) > before
    assert release(spark) > 1
    assert set(os.listdir(folder)) == before
    tiny._CACHE.clear()

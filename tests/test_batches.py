"""W20 deals the whole of the reference's 20 batches of 150."""

from collections import Counter

from chipmeter import catalogue
from chipmeter.sources import views as V


def test_seeded_batches_are_whole(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        positive = V.inventory(spark, sf).where("n_objects > 0").count()
        rows = catalogue.QUERIES["W20_seeded_batches"](spark, sf).collect()
        assert len({r.chip for r in rows}) == len(rows) == min(positive, 3000)
        sizes = Counter(r.batch for r in rows)
        assert sizes == {k: min(150, len(rows) - 150 * k) for k in range(-(-len(rows) // 150))}
    assert set(sizes.values()) == {150} and len(sizes) == 20

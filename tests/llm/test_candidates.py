"""What sets without a link have in common in the index, and rows parted before a join."""
import numpy as np
from pyspark.sql import functions as F

from prismtab.llm import jaccard
from prismtab.llm.common import parted


EVERY_BAND = {int(1.1 * 1.5625 ** i) + 1: 5000 for i in range(23)}


def some_sets(random, size: int, number: int) -> list[np.ndarray]:
    return [np.unique(random.integers(0, 1 << 64, size, dtype=np.uint64)) for _ in range(number)]


def test_sets_with_nothing_in_common_share_no_key():
    random = np.random.default_rng(5)
    for scheme, sizes in ((jaccard.Schemes(80, EVERY_BAND, 20_000), (60, 300, 900, 1200, 2500)),
                          (jaccard.Schemes(80, EVERY_BAND | {256: 10**9}, 3000, [(0.5, 0.001)]), (270, 300, 325))):
        for size in sizes:
            keys = np.concatenate([scheme.keys(values)[0] for values in some_sets(random, size, 12)])
            assert len(np.unique(keys)) == len(keys), size


def test_bounds_of_each_set_leave_keys_out():
    """A set near the start of its band leaves out more keys than the bound of the whole band allows."""
    scheme = jaccard.Schemes(80, EVERY_BAND, 20_000)
    for values in some_sets(np.random.default_rng(6), 350, 5):
        keys, spare = scheme.keys(values)
        assert sum(spare) > len(keys) // 8


def test_rows_are_parted_by_hash(spark):
    rows = spark.createDataFrame([(i, None if i == 7 else f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    wanted = rows.where("doc_id in (3, 7)").select(F.xxhash64("text").alias("h"))
    near, apart = parted(rows, F.xxhash64("text"), wanted, "h")
    assert sorted(r["doc_id"] for r in near.collect()) == [3, 7, 53, 103, 153]
    assert near.count() + apart.count() == 200 and apart.where("doc_id in (3, 7)").count() == 0
    assert parted(rows, F.xxhash64("text"), wanted.limit(0), "h")[1].count() == 200

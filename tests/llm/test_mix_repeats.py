"""Sources meet their targets where one row, or null ids of one size, repeat thousands of times."""
import collections

from prismtab.llm import mixing


def test_targets_with_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "s")] * 3000 + [(None, f"a b c d {i % 7}", "t") for i in range(2000)]
    rows += [(10 + i, "a b c d e f g h", "u") for i in range(300)]
    got = mixing.fair_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    taken, target, parts = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        parts[r.source] += r.part > 0
    assert all(abs(taken[s] - target[s]) <= 1 and parts[s] <= 1 for s in target)

"""Copies whose doc_id is null or carries other texts too."""
from prismtab.llm import jaccard


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, jaccard.one_of_each(docs).collect()), key=str)


def test_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{name}{i}" for i in range(40)) for name in "abcd")
    near = a + " more"
    rows = [(1, a), (None, a), (None, a), (None, near), (2, b), (2, near), (3, b), (None, c), (None, c), (None, c + " more"), (5, d), (5, d)]
    got = kept(spark, rows)
    assert [r for r in got if r[1] not in (c, c + " more")] == sorted([(1, a), (2, b), (5, d)], key=str)
    assert len([r for r in got if r[1] in (c, c + " more")]) == 1 and len(got) == 4

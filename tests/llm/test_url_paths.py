"""Path entries keep their case, and slashes count the same in entries and captures."""
from pyspark.sql import functions as F

from prismtab.llm import urls


def test_path_entries(spark):
    names = ["Example.org/Adult", "example.org/en/", "slash.org//a//b/", "Host.org/", "deep.org/a/b/c"]
    entries = spark.createDataFrame([(n, "spam", "add") for n in names], "pattern string, category string, action string").withColumn("listed_on", F.to_date(F.lit("2024-01-01")))
    met = ["http://example.org/Adult/1", "http://EXAMPLE.org/Adult", "http://example.org/en/x", "http://example.org//en", "http://slash.org/a/b/c/d/e",
           "http://slash.org//a///b", "http://host.org/any", "http://host.org", "http://deep.org//a//b//c//d"]
    free = ["http://example.org/adult/1", "http://example.org/EN/x", "http://example.org/english", "http://slash.org/a", "http://deep.org/a/b"]
    captures = spark.createDataFrame([(u,) for u in met + free], "url string").withColumn("fetched_at", F.to_timestamp(F.lit("2024-02-01")))
    got = {r.url: r.n_active for r in urls.url_verdicts(captures, entries).collect()}
    assert got == {u: 1 for u in met} | {u: 0 for u in free}


def test_dots_top_levels_and_missing_urls(spark):
    captures = spark.createDataFrame([(1, "http://a.com./x", "2024-01-02"), (2, "http://b.a.com/", "2024-01-02"), (3, None, "2024-01-02"), (4, "http://b.com", None),
                                      (5, "http://com/", "2024-01-02"), (6, "nothing", "2024-01-02")], "page_id long, url string, day string").selectExpr("page_id", "url", "timestamp(day) AS fetched_at")
    entries = spark.createDataFrame([("A.com.", "adult", "2024-01-01", "add")], "pattern string, category string, listed_on string, action string")
    got = {r["page_id"]: (r["listed"], r["n_active"]) for r in urls.url_verdicts(captures, entries).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (False, 0), 4: (False, 0), 5: (False, 0), 6: (False, 0)}
    top = spark.createDataFrame([("com", "all", "2024-01-01", "add")], entries.schema)
    assert {r["page_id"] for r in urls.url_verdicts(captures, top).where("listed").collect()} == {1, 2, 5}
    keys = captures.select(F.explode(urls.patterns_of(F.col("url"), 3, 0, shortest=2)).alias("k")).distinct()
    assert {r["k"] for r in keys.collect()} == {"a.com", "b.a.com", "b.com", "com"}

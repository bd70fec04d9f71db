from datetime import date

from quillspark.llm import url_filter as uf

ENTRIES = "kind string, key string, category string, verdict string, listed date, action string"


def day(n):
    return date(2024, 1, n)


def run(spark, captures, entries):
    c = spark.createDataFrame(captures, "id bigint, url string, fetched date").selectExpr("*", "'clash' as kind", "'clash' as key")
    e = spark.createDataFrame(entries, ENTRIES)
    return {(r["id"], r["fetched"].day if r["fetched"] else None): r for r in uf.evaluate(c, e).collect()}


def test_intervals_and_the_day_of_the_fetch(spark):
    e = [("host", "a.com", "spam", "block", day(5), "add"), ("host", "a.com", "spam", "block", day(10), "remove"),
         ("host", "a.com", "spam", "block", day(20), "add"), ("host", "a.com", "spam", "block", day(20), "add"),
         ("host", "b.com", "spam", "block", day(3), "add"), ("host", "b.com", "spam", "block", day(3), "remove"),
         ("host", None, "spam", "block", day(1), "add"), ("host", "c.com", "spam", "block", None, "add")]
    out = run(spark, [(1, "http://a.com/x", day(d)) for d in (4, 5, 9, 10, 19, 20, 31)] + [(2, "http://b.com/", day(9)), (3, "http://c.com", day(9))], e)
    assert {k: r["decision"] for k, r in out.items()} == {
        (1, 4): "none", (1, 5): "block", (1, 9): "block", (1, 10): "none", (1, 19): "none", (1, 20): "block", (1, 31): "block", (2, 9): "none", (3, 9): "none"}
    assert out[1, 31]["since"] == day(20) and out[1, 31]["n_active"] == 1


def test_the_most_specific_entry_decides(spark):
    e = [("domain", "example.com", "adult", "block", day(1), "add"), ("host", "www.example.com", "spam", "block", day(1), "add"),
         ("prefix", "www.example.com/en/", "section", "allow", day(1), "add"), ("prefix", "www.example.com/en/sub/", "section", "block", day(2), "add"),
         ("url", "www.example.com/en/sub/x?q=1", "reviewed", "allow", day(1), "add"),
         ("domain", "com", "b", "block", day(1), "add"), ("domain", "com", "a", "allow", day(1), "add"), ("domain", "com", "z", "block", day(2), "add")]
    urls = ["https://u@WWW.example.com:8080/en/sub/x?q=1#frag", "http://www.example.com/en/sub/x", "http://www.example.com/en/y", "http://www.example.com/",
            "http://other.example.com", "http://x.com/", "http://x.org/"]
    out = run(spark, [(i, u, day(9)) for i, u in enumerate(urls)], e)
    got = [(out[i, 9]["kind"], out[i, 9]["category"], out[i, 9]["decision"]) for i in range(len(urls))]
    assert got == [("url", "reviewed", "allow"), ("prefix", "section", "block"), ("prefix", "section", "allow"), ("host", "spam", "block"),
                   ("domain", "adult", "block"), ("domain", "z", "block"), (None, None, "none")]
    assert out[0, 9]["n_active"] == 8
    before = run(spark, [(0, "http://x.com/", day(1))], e)
    assert (before[0, 1]["category"], before[0, 1]["decision"]) == ("a", "allow")  # of one day the smaller category


def test_odd_rows(spark):
    captures = spark.createDataFrame([(1, None, day(1)), (2, "", day(1)), (3, "no url", None), (None, "http://a.com/", day(2)), (4, "http://a.com/", day(2)),
                                      (4, "http://a.com/", day(2)), (5, "http://" + "a." * 500 + "com/" + "d/" * 500, day(2))], "id bigint, url string, fetched date")
    entries = spark.createDataFrame([("url", "", "empty", "block", day(1), "add"), ("domain", "a.com", "s", "block", day(1), "add")], ENTRIES)
    rows = sorted((r["id"] or 0, r["decision"]) for r in uf.evaluate(captures, entries).collect())
    assert rows == [(0, "block"), (1, "block"), (2, "block"), (3, "none"), (4, "block"), (4, "block"), (5, "block")]
    assert uf.evaluate(captures, entries.limit(0)).count() == 7 and uf.evaluate(captures.limit(0), entries).count() == 0

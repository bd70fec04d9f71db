import hashlib

from pyspark.sql import functions as F

from quillspark.llm import fingerprints as fp

from .helpers import empty_documents, odd_documents


def vectors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["v"] for r in fp.with_vector(df, "text", "v").orderBy("i").collect()]


def test_order_does_not_matter_and_parts_add_up(spark):
    a, b, both, turned, twice, empty, null, blank = vectors(
        spark, ["one. two", "three!", "one. two\nthree!", "three!\n\none. two", "three!\nthree!", "", None, "\n\n"])
    assert both == turned == [(x + y) % fp.MODULUS for x, y in zip(a, b, strict=True)]
    assert twice == [2 * x % fp.MODULUS for x in b] != b
    assert empty == null == blank == [0] * fp.SIZE
    assert len(a) == fp.SIZE and a[fp.WIDE] == 1 and a[fp.WIDE + 1] == 2


def test_insert_undoes_delete(spark):
    df = spark.createDataFrame([("a\nb\nc", "b"), ("x", "y\nz")], "t string, u string")
    df = fp.with_vector(fp.with_vector(df, "t", "v"), "u", "w")
    for r in df.select("v", fp.insert(fp.delete(F.col("v"), F.col("w")), F.col("w")).alias("x"), fp.delete(F.col("v"), F.col("w")).alias("d")).collect():
        assert r["v"] == r["x"] and all(0 <= x < fp.MODULUS for x in r["d"])
    rest = fp.with_vector(spark.createDataFrame([("c\na",)], "t string"), "t", "v").first()["v"]
    assert df.select(fp.delete(F.col("v"), F.col("w"))).first()[0] == rest


def brute(docs):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in docs.collect())
    out = []
    for i, ((known, doc_id), text) in enumerate(rows):
        nxt, n = rows[(i + 1) % len(rows)][1], len(text)
        out.append((doc_id if known else None, n, text, nxt, text[:n - n // 2] + nxt[:n // 2]))
    return out


def test_query_against_brute_force(spark):
    from quillspark.llm import queries
    sf = "/root/testdata/sf0.001"
    want = {d: x for d, *x in brute(queries.table(spark, sf, "documents"))}
    rows = queries.QUERIES["op5_multiset_fingerprints"](spark, sf).collect()
    assert len(rows) == len(want)
    direct = [r["v"] for r in fp.with_vector(spark.createDataFrame([(r["doc_id"], want[r["doc_id"]][3]) for r in rows], "i bigint, t string"), "t", "v")
              .select(fp.to_string(F.col("v")).alias("v")).collect()]
    known = {}
    for r, fingerprint in zip(rows, direct, strict=True):
        n, text, nxt, edited = want[r["doc_id"]]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == fingerprint  # by deletion and insertion as from the whole text
        assert known.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if nxt == text:
            assert r["near_next"] == 1
    assert len(set(known.values())) == len(known)
    assert sum(r["near_edited"] for r in rows) > 3 * sum(r["near_next"] for r in rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = fp.edited_fingerprints(docs).collect()
    key = lambda d: (d is None, d or 0)
    got = sorted((key(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows)
    # repeated rows have one text, so the order of ties does not show
    assert got == sorted((key(d), n, hashlib.sha256(e.encode()).hexdigest()) for d, n, _, _, e in brute(docs))
    assert fp.edited_fingerprints(empty_documents(spark)).count() == 0
    one = fp.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_next_row_with_any_number_of_buckets(spark):
    df = spark.createDataFrame([(i * i, f"t{i}") for i in range(50)], "k bigint, t string").repartition(7)
    for n in (1, 2, 13, 200):
        out = {r["k"]: r["next_t"] for r in fp.with_next(df, "k", ["t"], buckets=n).collect()}
        assert out == {i * i: f"t{(i + 1) % 50}" for i in range(50)}


def test_rows_of_one_id_or_none_are_spread(spark):
    for share in ("null", "7"):
        df = spark.sql(f"select if(id < 600, cast({share} as bigint), id) as k, concat('t', id) as t from range(900)").repartition(5)
        out = fp.with_next(df, "k", ["t"], buckets=16)
        nxt = {r["t"]: r["next_t"] for r in out.collect()}
        seen, at = [], "t0"
        while at not in seen:
            seen.append(at)
            at = nxt[at]
        assert len(nxt) == len(seen) == 900 and at == "t0"
        # in one direction: the order's values go down once
        key = {f"t{i}": -1 if share == "null" and i < 600 else 7 if i < 600 else i for i in range(900)}
        assert sum(key[a] > key[b] for a, b in nxt.items()) == 1
        q = df.agg(F.percentile_approx("k", F.array(*[F.lit(i / 16) for i in range(1, 16)]), 10_000), F.avg(F.expr("int(k is null)"))).first()
        sizes = df.withColumn("_h", F.xxhash64("t")).groupBy(fp._buckets("k", q[0], q[1], 16)).count().collect()
        assert max(r["count"] for r in sizes) < 150


def test_repeated_rows_meet_their_next(spark):
    df = spark.createDataFrame([(1, "a")] * 40 + [(2, "b"), (3, "c")], "k bigint, t string").repartition(3)
    for n in (1, 4, 30):
        out = sorted((r["k"], r["next_t"]) for r in fp.with_next(df, "k", ["t"], buckets=n).collect())
        assert out == [(1, "a")] * 39 + [(1, "b"), (2, "c"), (3, "a")]


def test_many_short_lines_count_right(spark):
    n = 1_060_000
    long = F.array_join(F.array_repeat(F.lit("x"), n), "\n")
    df = spark.range(1).select(F.lit(1).alias("i"), long.alias("t"), F.concat(long, F.lit("\ny")).alias("u"))
    df = fp.likeness(fp.with_vector(fp.with_vector(df, "t", "v"), "u", "w"), "v", "w", "near")
    r = df.select("v", "near").first()
    assert r["v"][fp.WIDE + 1] == n and r["near"] > 0.99
    fields = [x >> s & (1 << fp._FIELD) - 1 for x in r["v"][fp.WIDE + 2:] for s in (0, fp._FIELD)]
    assert set(fields) == {0, n}

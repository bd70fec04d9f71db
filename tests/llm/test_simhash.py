import random
import re

import xxhash

from quillspark.llm import simhash

from .helpers import empty_documents, odd_documents


def plain(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, d):
    """Component of each fingerprint by comparing all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= d:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_are_all_pairs_within_the_distance(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    for d in (0, 1, 2, 3, 5):
        got = {tuple(sorted((r["a"] % (1 << 64), r["b"] % (1 << 64)))) for r in simhash.links(df, d).collect()}
        assert got == {tuple(sorted((a, b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= d}


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(-5, -9), (-9, -5), (7, 7)]
    out = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = dict.fromkeys(range(1, 41), 1) | dict.fromkeys(range(100, 130), 100) | dict.fromkeys(range(200, 209), 200) | {-5: -9, -9: -9}
    assert out == want


def test_query_against_brute_force(spark):
    from quillspark.llm import queries
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: plain(r["text"]) for r in queries.table(spark, sf, "documents").collect()}
    group, least = groups(docs.values(), 3), {}
    for d, f in docs.items():
        least[group[f]] = min(d, least.get(group[f], d))
    rows = queries.QUERIES["op6_simhash_near_dedup"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert int(r["fingerprint"], 16) == docs[r["doc_id"]] and len(r["fingerprint"]) == 16
        assert r["component_id"] == least[group[docs[r["doc_id"]]]]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], plain(r["text"]))
    by_text = {}
    for r in rows:
        assert r["fp"] % (1 << 64) == want[r["doc_id"]]
        by_text.setdefault(r["component"], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in by_text.values())
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2, 3)} == {0}  # no words: fingerprint zero
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0
    lone = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "e f g h")], "doc_id bigint, text string")).collect()
    assert [r["component_id"] for r in lone] == [None, None] and lone[0]["component"] != lone[1]["component"]

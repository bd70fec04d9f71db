"""Decision diagrams against a plain count over every order; filters against their definitions."""

import itertools
import random
import re

from quillspark.llm import filter_audit
from quillspark.llm.filter_audit import FILTERS

from .helpers import empty_documents, odd_documents, words


def brute(rows):
    """``rows``: ``(part, failing letters, good, toxic)``."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys(FILTERS, 0)
        for order in map("".join, itertools.permutations(FILTERS)):
            left = mine
            for i, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                out[part, order, i] = [len(left), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(r[1] == x for r in mine),
                                       sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, i), v in out.items():
            if p == part:
                v.append(shapley[order[i - 1]])
    return out


def as_dict(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
            for r in df.collect()}


def failing(text, is_copy):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), is_copy)
    return "".join(x for x, bad in zip(FILTERS, tests, strict=True) if bad)


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(n)))


def test_a_swapped_diagram_is_the_one_built_in_that_order():
    rng = random.Random(3)
    counts = {m: (rng.randint(0, 2), 1, 0) for m in range(16)}
    d = filter_audit.Diagram(4, counts)
    for level in filter_audit.swaps(4):
        d.swap(level)
        renumbered = {}
        for mask, w in counts.items():
            renumbered[sum(1 << i for i, f in enumerate(d.order) if mask >> f & 1)] = w
        fresh = filter_audit.Diagram(4, renumbered)
        assert [len(x) for x in d.levels] == [len(x) for x in fresh.levels]
        assert [s[1:] for s in d.steps()] == [s[1:] for s in fresh.steps()]


def test_audit_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y"]), "".join(x for x in FILTERS if rng.random() < 0.3), rng.random() < 0.5, rng.random() < 0.2) for _ in range(300)]
    rows += [("clean", "", True, False), ("all", FILTERS, False, True)]
    masks = spark.createDataFrame([(p, sum(1 << FILTERS.index(x) for x in f), 1, int(g), int(t)) for p, f, g, t in rows],
                                  "part string, mask int, n bigint, good bigint, toxic bigint")
    assert as_dict(filter_audit.audit(masks)) == brute(rows)


def test_documents_against_brute_force(spark):
    rng = random.Random(8)
    texts = [words(rng, 60), words(rng, 60) + " #", words(rng, 20), "A B C " * 30, words(rng, 80).upper(), "", None, "a\x1cb\xa0c\x85d " * 60, "É" * 10]
    rows = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""]), i % 3 == 0, i % 7 == 0) for i in range(120)]
    rows += [(None, texts[0], "s", False, False), (None, texts[0], "s", False, False), (5, rows[5][1], "s", False, False), (5, "other", "t", False, False)]
    docs = spark.createDataFrame([(r[0], r[1], r[2], "clash", 1) for r in rows], "doc_id int, text string, source string, part string, n int")
    labels = spark.createDataFrame([(r[0], int(r[3]), int(r[4])) for r in rows] + [(1, None, None), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    known = {}
    for i, _, _, g, t in rows:
        if i is not None:
            known[i] = (known.get(i, (0, 0))[0] or int(g), known.get(i, (0, 0))[1] or int(t))
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    want = brute([(s or "", failing(t or "", i is not None and i > least[t or ""]), *known.get(i, (0, 0))) for i, t, s, _, _ in rows])
    assert as_dict(filter_audit.audit_documents(docs, labels)) == want


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = "\n".join(words(rng, 30) for _ in range(50)).encode()
    want = [filter_audit.text_mask(t, len(t)) for t in (text, b"x" * 500, b" " * 500)]
    monkeypatch.setattr(filter_audit, "PIECE_BYTES", 64)
    assert [filter_audit.text_mask(t, len(t)) for t in (text, b"x" * 500, b" " * 500)] == want


def test_odd_and_empty(spark):
    from pyspark.sql import functions as F
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = odd_documents(spark).withColumn("source", F.lit(None).cast("string"))
    out = as_dict(filter_audit.audit_documents(odd, labels))
    n = odd.count()
    assert len(out) == 600 and {k[0] for k in out} == {""}
    assert all(v[0] + sum(out[p, o, j][1] for j in range(1, i + 1)) == n for (p, o, i), v in out.items())
    assert filter_audit.audit_documents(empty_documents(spark).withColumn("source", F.lit("s")), labels).count() == 0

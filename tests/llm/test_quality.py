import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import quality

from .helpers import empty_documents, odd_documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_counts_of_odd_rows(spark):
    rng = random.Random(2)
    more = [(100 + i, " ".join(rng.choices("a b c # d|e".split(), k=rng.randint(0, 90))) + "\n" * rng.randint(0, 3)) for i in range(60)]
    docs = odd_documents(spark).select("doc_id", "text", "stratum", "n_words").unionByName(
        spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality.counts(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(text[r["doc_id"]])


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, rate) for n in (1, 30, 700, 20_000) for rate in (0.01, 0.05) for k in (0, 1, 3, 20, 150) if k < n * rate]
    for rate in (0.01, 0.05):
        own = [(k, n) for k, n, r in cases if r == rate]
        df = spark.createDataFrame(own, "k bigint, n bigint")
        for r in df.withColumn("p", quality.log_binomial_cdf(F.col("k"), F.col("n"), rate)).collect():
            k, n = r["k"], r["n"]
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log(1 - rate) for i in range(k + 1)]
            top = max(logs)
            assert abs(r["p"] - (top + math.log(sum(math.exp(x - top) for x in logs)))) < 1e-8


def labelled(spark, n_good, n_bad, noise=0):
    rng = random.Random(5)
    rows = [(i, words(rng, 200), 1) for i in range(n_good)]
    rows += [(10_000 + i, " ".join(w + "###" for w in words(rng, 200).split()), 0) for i in range(n_bad)]
    rows += [(20_000 + i, " ".join(w + "###" for w in words(rng, 200).split()), 1) for i in range(noise)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality")


def cutoff(spark, *args):
    docs, labels = labelled(spark, *args)
    return {r["stratum"]: r for r in quality.cutoffs(quality.counts(docs), labels).collect()}


def test_cutoffs_need_proof(spark):
    proven = cutoff(spark, 800, 60)
    assert proven[1]["_symbols"] == 3.0 and proven[1]["_repeats"] is None and proven[0]["_symbols"] is None
    # at one per cent and these many tests 100 good rows prove nothing
    assert cutoff(spark, 100, 60)[1]["_symbols"] is None
    # nor are five per cent of good documents rejected
    assert cutoff(spark, 800, 60, 40)[1]["_symbols"] is None


def test_verdict(spark):
    docs, labels = labelled(spark, 800, 60)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] == (i < 10_000) for i in kept)
    rows = quality.judge_rows(docs.withColumn("kept", F.lit("clash")), labels)
    assert rows.filter("kept").select("doc.*").columns == ["doc_id", "text", "kept"] and rows.filter("kept").count() == 800


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1), (99, 1)], "doc_id bigint, quality int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["kept"] == (not r["base_failed"]) for r in rows)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.judge(docs, none).count() == docs.count()
    assert quality.judge(empty_documents(spark), labels).count() == 0


def counted(rng, n, good_share=0.6):
    """Rows of counts in which bad ones tend to be worse in every rule, with labels."""
    rows = []
    for i in range(n):
        good = rng.random() < good_share
        odd = (lambda p: rng.random() < p * (0.02 if good else 1))  # noqa: B023
        w = rng.choice([120, 300, 600, 1500])
        rows.append((i, w, w * (8 if odd(0.3) else 5), int(w * (rng.uniform(0.3, 2) if odd(0.4) else rng.uniform(0, 0.09))), int(w * (rng.uniform(0.2, 0.49) if odd(0.3) else 0.01)),
                     20, int(20 * (rng.uniform(0.3, 1) if odd(0.4) else 0.04)), False, int(good)))
    return rows


COUNTED = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_repeat_words bigint, n_lines bigint, n_dup_lines bigint, base_failed boolean, quality int"


def plain_cutoffs(rows):
    names = [c.split()[0] for c in COUNTED.split(", ")]
    docs = [dict(zip(names, r, strict=True)) for r in rows]
    rate, level = quality.MAX_RATE / len(quality.RULES), quality.ERROR / (len(quality.RULES) * (len(quality.STRATA) + 1))
    out = {}
    for s in range(len(quality.STRATA) + 1):
        mine = [d for d in docs if sum(d["n_words"] >= x for x in quality.STRATA) == s]
        n = sum(d["quality"] for d in mine)
        left = mine
        for rule, (value, cuts) in quality.RULES.items():
            worth = lambda d: eval(value, {}, d)  # noqa: E731, S307, B023
            best = (0, None)
            for c in cuts:
                k = sum(d["quality"] for d in mine if worth(d) >= c)
                if n and sum(math.comb(n, i) * rate ** i * (1 - rate) ** (n - i) for i in range(k + 1)) > level or not n or k >= n * rate:
                    break
                gain = sum(1 - d["quality"] - quality.GOOD_COST * d["quality"] for d in left if worth(d) >= c)
                if gain > best[0]:
                    best = (gain, c)
            out[s, rule] = best[1]
            if best[1] is not None:
                left = [d for d in left if worth(d) < best[1]]
    return out


def test_cutoffs_with_several_rules_against_brute_force(spark):
    rows = counted(random.Random(4), 7000)
    df = spark.createDataFrame(rows, COUNTED)
    got = quality.cutoffs(df.drop("quality"), df.select("doc_id", "quality")).collect()
    want = plain_cutoffs(rows)
    assert {(r["stratum"], rule): r[f"_{rule}"] for r in got for rule in quality.RULES} == want
    on = {rule for (_, rule), c in want.items() if c is not None}
    assert len(on) >= 3
    # fresh good rows: no stratum loses more than the bound
    fresh = spark.createDataFrame([r for r in counted(random.Random(9), 20_000) if r[-1] == 1], COUNTED)
    limits = spark.createDataFrame([r.asDict() for r in got], "stratum int, " + ", ".join(f"_{r} double" for r in quality.RULES))
    lost = quality._apply(fresh, limits).groupBy(quality.stratum().alias("s")).agg(F.avg(F.expr("cast(not kept as int)")).alias("rate")).collect()
    assert all(r["rate"] <= quality.MAX_RATE for r in lost)

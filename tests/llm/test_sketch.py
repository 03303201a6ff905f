import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lenscube.llm import sketch


def exact(a, b):
    x, y = Counter(sketch.paragraphs(a)), Counter(sketch.paragraphs(b))
    both, either = sum((x & y).values()), sum((x | y).values())
    return both / either if either else 1.0


def ordered(rows, spark):
    """(doc_id, text) by descending id, nulls last, equal ids by hash of the text."""
    df = spark.createDataFrame([(d, t or "") for d, t in rows], "d long, t string").selectExpr("d", "t", "xxhash64(t) as h")
    return [(x.d, x.t) for x in sorted(df.collect(), key=lambda x: (x.d is None, -(x.d or 0), x.h, x.t))]


def want(rows, spark):
    order = ordered(rows, spark)
    out = []
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, new, after = (sketch.digests(x) for x in (t, e, nxt))
        prints = sketch.fingerprints([own]) + sketch.fingerprints([new]) + sketch.fingerprints([after])
        gone, come = np.setdiff1d(own, new), np.setdiff1d(new, own)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *prints[:2], sketch.near(prints[:1], prints[1:2])[0], sketch.near(prints[:1], prints[2:])[0], gone.tobytes(), come.tobytes()))
    return out


def key(x):
    return (x[0] is None, x[0] or 0, x[1:])


def test_equals_brute_force(spark):
    r = random.Random(8)
    lines = [f"line number {i} " * r.randint(1, 9) for i in range(60)]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "é𝄞x", "y" * 300_000, texts[0], texts[0]]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    rows += [(7, "again"), (7, "again"), *((None, f"no id {k}") for k in range(40))]
    for per_bucket in (5, 1000):
        df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, bucket string").repartition(3)
        got = [tuple(x)[:-1] for x in sketch.against_next(df, per_bucket).collect()]
        assert sorted(got, key=key) == sorted(want(rows, spark), key=key)


def test_an_id_that_fills_many_ranges_is_split(spark):
    keys = np.repeat(np.array([5, 6, 7, 8, 9], np.int64), [10, 300, 10, 10, 10])
    hashes = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, len(keys), dtype=np.int64)
    order = np.lexsort((hashes, keys))
    keys, hashes = keys[order], hashes[order]
    buckets = sketch._buckets(keys, hashes, sketch._layout(keys[10::10]))
    assert (np.diff(buckets) >= 0).all() and np.bincount(buckets).max() <= 40


def test_likeness_comes_from_the_returned_fingerprints(spark):
    r = random.Random(4)
    texts = ["\n".join(str(r.random()) for _ in range(n)) for n in (1, 3, 10, 40, 40, 400, 3000, 3000)]
    rows = sketch.against_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy(F.desc("doc_id")).collect()
    prints = [x.fingerprint for x in rows]
    assert [x.near_edited for x in rows] == sketch.near(prints, [x.edited_fingerprint for x in rows])
    assert [x.near_next for x in rows] == sketch.near(prints, prints[1:] + prints[:1])
    for x, nxt in zip(rows, rows[1:] + rows[:1]):
        t, n = texts[x.doc_id], texts[nxt.doc_id]
        assert abs(x.near_edited - exact(t, t[: len(t) - len(t) // 2] + n[: len(t) // 2])) < 0.25
        assert abs(x.near_next - exact(t, n)) < 0.25


def test_estimates_scatter_around_the_truth():
    r = np.random.default_rng(6)
    for shared, other in ((900, 100), (500, 500), (100, 900)):
        seen = []
        for _ in range(40):
            both = r.integers(0, 1 << 63, shared, dtype=np.uint64)
            a, b = (np.concatenate([both, r.integers(0, 1 << 63, other, dtype=np.uint64)]) for _ in range(2))
            seen.append(sketch.near(sketch.fingerprints([a]), sketch.fingerprints([b]))[0])
        truth = shared / (shared + 2 * other)
        assert abs(np.mean(seen) - truth) < 0.07 and np.std(seen) < 0.12


def test_differences_recover_the_digests():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 50, 3000):
        a = np.unique(r.integers(0, 1 << 63, n + 20, dtype=np.uint64))
        b = np.concatenate([a[n // 2 :], r.integers(0, 1 << 63, n, dtype=np.uint64)])
        gone, come, attempts = sketch.differences([a], [b])[0]
        assert gone.tolist() == np.setdiff1d(a, b).tolist() and come.tolist() == np.setdiff1d(b, a).tolist()
        assert attempts == 1 or n > 10


def test_single_document_and_empty_table(spark):
    one = sketch.against_next(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.near_next, x.edited_sha256) for x in one] == [(5, 1.0, hashlib.sha256(b"abab").hexdigest())]
    assert sketch.against_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0

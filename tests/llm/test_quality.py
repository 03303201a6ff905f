import math
import zlib

import numpy as np

from lenscube.llm import quality, tuning
from lenscube.llm.common import load

SF = "/root/testdata/sf0.01"


def test_scores_rank_held_out_documents(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[x.doc_id].score, x.quality) for x in labels.collect() if got[x.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc


def plain_stats(text):
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    return [*(sum(b in set(c) for b in raw) for c in quality._CLASSES.values()), len(raw), len(words), len(set(words)), len(lines), len(set(lines))]


def plain_features(row, usual):
    *counts, n, w, distinct, lines, distinct_lines = row
    pb, pw = quality.PRIOR_BYTES, quality.PRIOR_WORDS
    shares = [math.log((c + pb * u + 0.05) / (n + pb + 0.05 * len(counts))) for c, u in zip(counts, usual)]
    letters, kinds, per = usual[len(counts) :]
    more = [n - counts[3] + letters * pw + 0.01, distinct + kinds * pw]
    return [*shares, math.log1p(n), math.log1p(w), *(math.log(x / (w + pw)) for x in more), math.log((distinct_lines + 2) / (lines + 2)), math.log((lines + per * pw) / (w + pw))]


def test_equals_brute_force(spark):
    docs, labels = load(spark, SF, "documents").select("doc_id", "text").collect(), load(spark, SF, "labels").collect()
    rows = {r.doc_id: plain_stats(r.text) for r in docs}
    total = np.array(list(rows.values())).sum(axis=0)
    k = len(quality._CLASSES)
    usual = [*total[:k] / total[k], (total[k] - total[3]) / total[k + 1], total[k + 2] / total[k + 1], total[k + 3] / total[k + 1]]
    x = {d: np.array(plain_features(r, usual)) for d, r in rows.items()}
    logs = []
    for c in (0, 1):
        own = np.array([x[r.doc_id] for r in labels if r.quality == c and zlib.crc32(str(r.doc_id).encode()) % 5])
        every = sum(r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5 > 0 for r in labels)
        n, d = own.shape
        cov = np.cov(own.T, bias=True)
        weight = min(1, quality.SHRINKAGE + d / (n + d))
        cov = (1 - weight) * cov + weight * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(d)
        inverse, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        logs.append({i: math.log((n + 1) / (every + 2)) - 0.5 * ((v - own.mean(0)) @ inverse @ (v - own.mean(0)) + det) for i, v in x.items()})
    got = {r.doc_id: r.score for r in quality.classify(load(spark, SF, "documents"), load(spark, SF, "labels")).collect()}
    want = {i: 1 / (1 + math.exp(min(700, logs[0][i] - logs[1][i]))) for i in x}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in want)


def test_density_equals_the_formula():
    r = np.random.default_rng(0)
    x = r.normal(size=(50, 3))
    n, t, p = np.array([30.0, 20.0]), np.stack([x[:30].sum(0), x[30:].sum(0)]), np.stack([x[:30].T @ x[:30], x[30:].T @ x[30:]])
    m = quality.fit_moments(n, t, p, shrinkage=0.2, ridge=0.02)
    logs = []
    for c, own in ((0, x[:30]), (1, x[30:])):
        cov = np.cov(own.T, bias=True)
        w = min(1, 0.2 + 3 / (len(own) + 3))
        cov = (1 - w) * cov + w * np.diag(np.diag(cov)) + 0.02 * np.eye(3)
        z = x[0] - own.mean(0)
        logs.append(math.log((len(own) + 1) / 52) - 0.5 * (z @ np.linalg.inv(cov) @ z + math.log(np.linalg.det(cov))))
    assert math.isclose(m.score(x[:1])[0], 1 / (1 + math.exp(logs[0] - logs[1])), rel_tol=1e-9)


def test_nulls_empties_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "a b", 5), (None, "x", 5)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, labels).collect()] == [0.5] * 4
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.keep_good(docs, labels).count() == 4
    odd = docs.selectExpr("doc_id", "text", "y as score", "y as f", "y as `a.b`")
    assert quality.keep_good(odd, labels).columns == odd.columns and quality.keep_good(docs.where("false"), labels).count() == 0


def test_choice_of_constants_sees_no_held_out_row():
    ids = list(range(300))
    texts = [("good words in a plain line. " if i % 3 else "#### 123 !!!! ") * (1 + i % 7) for i in ids]
    labels = [int(bool(i % 3)) for i in ids]
    other = [1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y for i, y in zip(ids, labels, strict=True)]
    blank = ["" if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in zip(ids, texts, strict=True)]
    small = ((20, 60), (2,), (0.1,), (0.005, 0.1))
    first = tuning.choose([tuning.training_rows(ids, texts, labels)], small)
    assert len(first) == 4 and first[0][1][0] < 0.05
    assert first == tuning.choose([tuning.training_rows(ids, blank, other)], small)

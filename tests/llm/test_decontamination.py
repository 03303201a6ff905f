import hashlib
import random
import re

import numpy as np
import pytest

from lenscube.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
fold = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    out = {}
    for d, text in docs:
        words, hit, names = fold(text), set(), set()
        for i, body in items:
            w = fold(body)
            if i is None or not w:
                continue
            for s in range(max(1, len(w) - window + 1)):
                part = w[s : s + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        names.add(str(i))
        near = sum(1 for k in {str(i) for i, b in items if i is not None and fold(b)} if any(close(words, fold(b)) for i, b in items if str(i) == k))
        out[d] = (len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), near)
    return out


def close(words, asked, within=30):
    terms = sorted(set(asked), key=lambda w: (-len(w.encode()), w.encode()))[:6]
    return bool(terms) and any(w == terms[0] and set(terms) <= set(words[max(0, k - within) : k + within + 1]) for k, w in enumerate(words))


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_equals_brute_force(spark, block):
    r = random.Random(1)
    vocabulary = ["a", "b", "é", "Zz", "w1"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "!!! ..."), (63, "b " * 5000), (64, "x y,The END")]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 14)))) for i in range(8)]
    items += [(10, None), (11, ""), (None, "a b"), (12, "the-end"), (9, docs[3][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, items int")
    got = dec.report(dec.search(dec.index(d, segment_bytes=500), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block))
    assert {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated, x.n_near) for x in got.collect()} == brute(docs, items)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_rows_that_repeat_an_id_or_have_none_stay_apart(spark, block):
    texts = [(7, "a b c"), (7, "x a b"), (7, "x a b"), (7, "c d and more"), (None, "a b"), (None, None), (None, "q c d")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "b c")], "item_id long, text string")
    got = dec.report(dec.search(dec.index(docs, segment_bytes=4), items, block_bytes=block)).collect()
    want = [(d, *brute([(d, t)], [(1, "a b"), (2, "c d"), (3, "b c")])[d]) for d, t in texts]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_postings_are_read_back():
    row = dict(zip(("doc_ids", "known", "ends", "terms", "counts", "postings"), dec.segment([1, 2, 3], ["a x x b", None, "b a c b"])))
    p = dec.Postings(row)
    names = {k: w for w, k in p.at.items()}
    assert [names[c].decode() for c in p.codes.tolist()] == "a x x b b a c b".split()
    assert p.doc.tolist() == [0] * 4 + [2] * 4
    assert p.occurring(np.array([p.at[b"b"]]), np.array([3]), np.array([8])).tolist() == [3]


def test_many_items_are_found_by_their_rarest_terms():
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    text = [r.choice(words) for _ in range(6000)]
    items = [(str(k), [r.choice(words).encode() for _ in range(r.randint(3, 30))]) for k in range(3000)]
    for k in range(40):
        at = r.randint(0, 5900)
        items[k * 7] = (str(k * 7), [w.encode() for w in text[at : at + 25]])
    p = dec.Postings(dict(zip(("doc_ids", "known", "ends", "terms", "counts", "postings"), dec.segment([1], [" ".join(text)]))))
    followed = []
    p.postings, original = (lambda terms: (followed.append(len(x[1])) or x for x in original(terms))), p.postings
    item, start, end = dec.Items(items, 10).found(p)
    got = {}
    for i, a, e in zip(item.tolist(), start.tolist(), end.tolist()):
        got.setdefault(i, set()).update(range(a, e))
    grams = {}
    for k in range(len(text)):
        for n in range(3, 11):
            grams.setdefault(tuple(w.encode() for w in text[k : k + n]), []).append(k)
    want = {}
    for i, (_, ws) in enumerate(items):
        n = min(10, len(ws))
        for s in range(len(ws) - n + 1):
            for k in grams.get(tuple(ws[s : s + n]), []):
                want.setdefault(i, set()).update(range(k, k + n))
    assert got == want and len(want) >= 40 and sum(followed) < 40 * len(items) * 20


def test_proximity_over_documents(spark):
    docs = spark.createDataFrame([(7, "x a y B"), (8, "a " + "z " * 9 + "b"), (9, None), (10, "b a a"), (11, "b a")], "doc_id long, text string")
    got = dec.proximity(dec.index(docs), ["a b", "", "nowhere z", "b a a"], 3)
    assert sorted(map(tuple, got.collect())) == [(7, "a b", 1), (10, "a b", 1), (10, "a b", 2), (10, "b a a", 0), (11, "a b", 1)]


def test_keep_clean_keeps_the_others_and_their_columns(spark):
    docs = spark.createDataFrame([(1, "Hi. One two, three! End.", "en"), (2, "nothing", None), (3, None, "de")], "doc_id long, text string, items string")
    items = spark.createDataFrame([(1, "one two three"), (2, "x y")], "item_id long, text string")
    for block in (1, 1 << 20):
        assert [tuple(x) for x in dec.keep_clean(docs, items, block_bytes=block).orderBy("doc_id").collect()] == [(2, "nothing", None), (3, None, "de")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert dec.report(dec.search(dec.index(none), none)).count() == 0
    assert [x.contaminated for x in dec.report(dec.search(dec.index(some), none)).collect()] == [False]

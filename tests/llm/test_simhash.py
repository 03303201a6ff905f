import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lenscube.llm import simhash
from lenscube.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, radius=3):
    comp = {d: d for d, _ in pairs}
    changed = True
    while changed:
        changed = False
        for a, x in pairs:
            for b, y in pairs:
                if (x ^ y).bit_count() <= radius and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(r.choice(["a", "B", "cç", "d1"]) + str(r.randint(0, 30)) for _ in range(r.randint(40, 200))) for _ in range(25)]
    texts = [None, "", " \t\n", "one", "one two", *base, *base[:5]]
    for t in base[:12]:
        w = t.split()
        for _ in range(4):
            w[r.randrange(len(w))] = "x"
            texts.append("  ".join(w))
    rows = [(i * 3, t, i) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, bits int")).collect()
    prints = [(d, brute_print(t)) for d, t, _ in rows]
    assert {x.doc_id: x.fingerprint for x in got} == {d: f"{p:016x}" for d, p in prints}
    assert {x.doc_id: x.component_id for x in got} == brute_components(prints)


def connected(n, edges):
    got = list(range(n))
    for _ in range(n):
        before = list(got)
        for a, b in edges:
            got[a] = got[b] = min(got[a], got[b])
        if got == before:
            break
    return dict(enumerate(got))


def test_forest_connects_what_lies_within_the_radius():
    r = np.random.default_rng(2)
    bits = np.unique(r.integers(0, 1 << 9, 300).astype(np.uint64) * np.uint64(0x0101010101) % np.uint64(1 << 62))
    want = brute_components([(i, int(x)) for i, x in enumerate(bits)])
    forest = simhash.Forest(bits, 3, tile=16)
    forest.compare(np.arange(len(bits)))
    assert connected(len(bits), forest.edges) == want and len(forest.edges) == len(want) - len(set(want.values()))
    assert forest.compared and forest.skipped
    halves = simhash.Forest(bits, 3, tile=16)
    left, right = np.arange(0, len(bits), 2), np.arange(1, len(bits), 2)
    halves.compare(left), halves.compare(right), halves.compare(left, right)
    assert connected(len(bits), halves.edges) == want


def test_masks_and_bands_meet_within_the_radius():
    r = random.Random(4)
    for n, radius in ((500, 3), (10**5, 3), (10**9, 3), (10**12, 3), (10**6, 7), (10**5, 0)):
        every = simhash.masks(n, radius)
        assert (every == [0]) == (n < 1024)
        for _ in range(60):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), radius):
                y ^= 1 << b
            meet = False
            for mask in every:
                own, under = simhash.keys(np.array([x, y], np.uint64), radius, mask)
                meet |= own[0] in (own[1], under[1]) or own[1] == under[0]
            assert meet


def test_tiles_decide_in_the_query(spark):
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 62, 3000, dtype=np.uint64)
    near = base[:400] ^ (np.uint64(1) << r.integers(0, 62, 400).astype(np.uint64))
    bits = np.unique(np.concatenate([base, near]))
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(bits.view(np.int64).tolist())], "node long, bits long")
    count = spark.sparkContext.accumulator(0)
    got = connected(len(bits), [(e.u, e.v) for e in simhash.links(nodes, 3, count).collect()])
    forest = simhash.Forest(bits, 3)
    forest.compare(np.arange(len(bits)))
    assert got == connected(len(bits), forest.edges) and sum(a != b for a, b in got.items()) >= 390
    assert count.value > 50


def test_a_large_group_is_dealt_to_tasks_for_each_pair_of_parts():
    r = np.random.default_rng(1)
    n = 50_000
    bits = r.integers(0, 1 << 62, n, dtype=np.uint64).view(np.int64)
    batch = pa.RecordBatch.from_pydict({"key": np.zeros(n, np.int64), "node": np.arange(n), "bits": bits, "below": np.zeros(n, np.int32), "size": np.full(n, n)})
    (columns,) = list(simhash._dealt([batch]))
    _, sizes = np.unique(columns[0], return_counts=True)
    assert len(sizes) == 10 and sizes.max() < 2.1 * n / 4  # four parts, ten pairs of them
    whole = set(zip(columns[1].tolist(), columns[4].tolist()))
    assert len(whole) == n  # a node has one part


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.component for x in got} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_first_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y"), (3, None, "z"), (4, "q r s t u", "z")], "doc_id long, text string, node string")
    assert sorted(x.doc_id for x in simhash.keep_first(docs).collect()) == [1, 3, 4]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.keep_first(docs.where("false")).count() == 0


def test_keep_first_with_any_column_names_nulls_and_repeats(spark):
    rows = [(1, "a b c d", 1, 2, 3, "r"), (1, "other words here", 1, 2, 3, "r"), (1, "other words here", 1, 2, 3, "r")]
    rows += [(None, "same", 1, 2, 3, "r"), (None, "same", 1, 2, 3, "r"), (None, "same", 9, 2, 3, "r"), (None, "else", 1, 2, 3, "r"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int, _guard int, `a.b` int, row string")
    got = [sorted(map(tuple, simhash.keep_first(docs.repartition(n)).collect()), key=repr) for n in (1, 3, 5)]
    assert got[0] == got[1] == got[2] and simhash.keep_first(docs).columns == docs.columns
    assert sorted(str(x[:2]) for x in got[0]) == sorted([str((1, next(x[1] for x in got[0] if x[0] == 1))), "(None, 'same')", "(None, 'else')", "(None, None)"])


def test_keep_first_catches_near_copies_and_leaves_others(spark):
    r = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    rows, near = [], []
    for k in range(60):
        base = [r.choice(words) for _ in range(150)]
        rows.append((10 * k, " ".join(base)))
        w = list(base)
        for _ in range(2):
            w[r.randrange(150)] = "changed"
        near.append(10 * k + 5)
        rows.append((10 * k + 5, " ".join(w)))
        half = base[:75] + [r.choice(words) for _ in range(75)]
        rows.append((10 * k + 7, " ".join(half)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in simhash.keep_first(docs).collect()}
    assert all({10 * k, 10 * k + 7} <= kept for k in range(60)) and len(kept & set(near)) <= 12
    single = {x.doc_id for x in simhash.keep_first(docs, radius=3, prints=1).collect()}
    assert len(single & set(near)) > len(kept & set(near))
    every = {x.doc_id for x in simhash.keep_first(docs, radius=5, prints=4, least=0.99).collect()}
    assert len(every) == len(rows)  # no pair has that similarity, whatever the fingerprints say


def test_nodes_with_equal_fingerprints_link(spark):
    nodes = spark.createDataFrame([(1, 7, 100), (2, 7, 1 << 40), (3, 9999, 1 << 40), (4, 123456789, 77)], "node long, bits long, bits_1 long")
    got = {(e.u, e.v) for e in simhash.links(nodes, 0).collect()}
    assert connected(5, list(got)) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4}


def test_candidates_are_confirmed_by_exact_sets_in_parts(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(12):
        base = [r.choice(words) for _ in range(80)]
        for n in (0, 1, 3, 5, 8, 12, 20):
            w = list(base)
            for at in r.sample(range(80), n):
                w[at] = "x"
            texts.append(" ".join(w))
    texts += [None, "", "one two", "one two", "one three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = docs.select("doc_id", (F.col("doc_id") % 2).alias("component"))

    def grams(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    want = {k: k for k in range(len(texts))}
    for a in want:
        for b in want:
            x, y = grams(texts[a]), grams(texts[b])
            if a < b and a % 2 == b % 2 and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((want[a], want[b]))
                want = {k: low if v == high else v for k, v in want.items()}
    edges = [(e.u, e.v) for e in simhash.confirmed(docs, members).collect()]
    assert connected(len(texts), edges) == want
    sets = [np.unique(simhash.hashes(t, 5).astype(np.uint32)) for t in texts]
    part = np.arange(len(texts)) // 2 % 3
    dealt = []
    for x in range(3):
        for y in range(x, 3):
            own = np.flatnonzero((part == x) | (part == y))
            for c in (0, 1):
                mine = own[own % 2 == c]
                dealt += simhash._confirmed(mine, part[mine], [sets[k] for k in mine], 0.8)
    assert connected(len(texts), dealt) == want

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lenscube.llm import repeats, suffix


def brute(rows, length):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in texts:
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w not in first or (d, s) < first[w]:
                first[w] = (d, s)
    out = []
    for d, raw in texts:
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] != (d, s):
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a\x00"])
def test_suffix_array_and_prefixes(letters):
    r = random.Random(len(letters))
    raw = ("".join(r.choice(letters) for _ in range(600)) * 2 + "".join(r.choice(letters) for _ in range(300))).encode()
    data = np.frombuffer(raw, np.uint8)
    order = suffix.suffix_array(data)
    keys = [raw[i:] for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(raw)))
    got = suffix.common_prefixes(data, order, 100, lane=7)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == min(n, 100)


def test_blocks_of_a_shard_meet_by_binary_search():
    r = random.Random(9)
    base = bytes(r.choice(b"abc\x00") for _ in range(400))
    parts = sorted({base[a : a + r.randint(100, 176)] for a in (r.randint(0, 220) for _ in range(40))})
    parts = [p for p in parts if len(p) >= 100]
    doc, start = np.arange(len(parts))[::-1].copy(), np.arange(len(parts)) * 5
    whole = set(zip(*(x.tolist() for x in repeats.removals(parts, doc, start, 100))))
    assert whole == set(zip(*(x.tolist() for x in repeats.removals(parts, doc, start, 100, block=500))))


def test_memory_of_a_large_shard_is_bounded():
    r = np.random.default_rng(2)
    n = 30_000
    parts = [x.tobytes() for x in r.integers(97, 123, (n, 176), dtype=np.uint8)]
    for k in range(0, 200, 2):  # windows that two blocks share
        parts[n - 1 - k] = parts[k][30:] + parts[n - 1 - k][:30]
    tracemalloc.start()
    segment, offset = repeats.removals(parts, np.arange(n), np.zeros(n, np.int64), 100, block=1 << 20)
    assert tracemalloc.get_traced_memory()[1] < 30 * 176 * n
    tracemalloc.stop()
    assert sorted(zip(segment.tolist(), offset.tolist())) == sorted((n - 1 - k, o) for k in range(0, 200, 2) for o in range(47))


def test_a_passage_in_a_third_of_the_rows(spark):
    r = random.Random(11)
    passage = " ".join(str(r.random()) for _ in range(12))
    rows = [(i, f"{r.random()} " + (passage + f" {r.random()}" if i % 3 == 0 else "")) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    batches = [pa.RecordBatch.from_pydict({"uid": [i for i, _ in rows], "text": [t for _, t in rows]})]
    sent = list(repeats._anchors(batches, 3, 100))
    counted = sum(len(h) // 8 for columns in sent for h in columns[1])
    spans = sum(len(x) // 8 for columns in sent for x in columns[3])
    assert spans > 20_000 and counted < spans / 4  # a hot anchor goes to its shard once a slice
    got = {x.doc_id: x.n_removed for x in repeats.report(repeats.remove_repeats(df)).collect()}
    assert got[0] == 0 and all((got[i] >= len(passage)) == (i % 3 == 0) for i in range(1, 20_000))


def test_length_is_checked(spark):
    with pytest.raises(ValueError, match="32 to 127"):
        repeats.remove_repeats(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 128)


def test_long_texts_are_cut_into_the_same_windows():
    r = np.random.default_rng(5)
    data, ends = r.integers(97, 100, 3000).astype(np.uint8), np.array([10, 1500, 1500, 3000])
    for most in (150, 1000):
        got = repeats.segments_of(data, ends, 100, most)
        windows = [(d, f + k, h) for d, f, c, h in zip(*(x.tolist() for x in got)) for k in range(c)]
        want = repeats.segments(data, ends, 100)
        assert windows == [(d, f + k, h) for d, f, c, h in zip(*(x.tolist() for x in want)) for k in range(c)]


def test_equals_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefé ") for _ in range(r.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        t = " ".join(word() for _ in range(r.randint(0, 120)))
        if i % 3 == 0:
            a = r.randint(0, 100)
            t = t[:50] + passage[a : a + r.randint(90, 200)] + t[50:]
        if i % 7 == 0:
            t = t + t[: r.randint(50, 300)]
        rows.append((i, t))
    rows += [(60, rows[0][1]), (61, rows[3][1][5:]), (62, None), (63, ""), (64, "z" * 5000), (65, "z" * 99), (66, "zy" * 300), (60, rows[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in r.sample(rows, len(rows))], "doc_id long, text string, uid string").repartition(3)
    got = sorted(tuple(x) for x in repeats.report(repeats.remove_repeats(df)).collect())
    assert got == brute(rows, 100)


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, "q" * 150), (3, "q" * 150)], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in repeats.report(repeats.remove_repeats(df)).collect()}
    assert got == {3: 149, None: 150}  # the first q of document 3 is in no later window
    assert repeats.report(repeats.remove_repeats(df.where("false"))).count() == 0

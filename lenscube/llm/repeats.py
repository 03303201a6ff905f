"""Exact repeated-substring removal by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or earlier in
the same document). Every window of that length has one anchor, its least hashed k-gram; windows of one
anchor in a row are a segment, and equal windows always lie in segments of equal anchors. So:

1. anchors are counted in shards of the anchors' hashes; only segments whose anchor occurs again go on. Anchors
   that occur twice in a slice of text need no count: their segments go on directly, spread over all tasks, and
   the shard gets the anchor once a slice;
2. the bytes of those segments go to shards by anchor, equal segments having been reduced to the earliest before
   in every task, HELD bytes of them at a time;
3. each shard, in blocks of bounded size, has its suffix array and common prefixes; runs of common prefixes
   of ``length`` or more are the equal windows, and the sorted windows of one shard's blocks meet by binary search.
   All windows but the earliest of each run are removed.

The texts are shuffled once; that exchange serves the segments and the result. A shard is one pandas group: what
one hot anchor brings is held by one task. That is 24 bytes a slice in step 1 and, in step 2, each segment
that differs in a byte once, and equal ones once a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lenscube.llm.common import map_rows, slices
from lenscube.llm.suffix import _packed, common_prefixes, suffix_array

GRAM = 24
#: Bytes of text in a slice, of segments in a suffix array, and aimed at in a shard.
SLICE, BLOCK, SHARD = 2 << 20, 3 << 20, 6 << 20
#: Bytes of segments that a task holds before it sends them; windows that are compared at a time.
HELD, AT_ONCE = 12 << 20, 1 << 16
#: A segment in one number: shard, start and number of windows.
SHARD_BITS, START_BITS, COUNT_BITS = 25, 31, 7
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
ANCHORS = "shard int, hash binary, uid binary, at binary"
SEGMENTS = "shard int, data binary, size binary, doc binary, uid binary, start binary, removed binary"
SPANS = "uid long, doc long, span long"
KEPT = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept binary"


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, number of windows, anchor hash) of each segment of the joined documents."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    p = _packed(data, little=True)
    last = n - GRAM + 1
    h = p[:last] * _C1
    h ^= (p[8 : last + 8] * _C2) ^ ((p[8 : last + 8] * _C2) >> np.uint64(29))
    h = (h ^ (h >> np.uint64(32))) * _C3
    h ^= (p[16 : last + 16] * _C3) ^ (h >> np.uint64(31))
    h = (h ^ (h >> np.uint64(29))) * _C1
    least = (h >> np.uint64(24)) << np.uint64(24) | np.arange(last, dtype=np.uint64)
    width, done = length - GRAM + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)  # the anchor of each window
    doc = np.searchsorted(ends, np.arange(len(at)), side="right")
    valid = np.arange(len(at)) + length <= ends[doc]
    start = np.flatnonzero(valid)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    anchor = at[start]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)))
    first = np.flatnonzero(new)
    return doc[start[first]], start[first], np.diff(np.append(first, len(start))), h[anchor[first]]


def segments_of(data: np.ndarray, ends: np.ndarray, length: int, most: int = 1 << 23) -> tuple[np.ndarray, ...]:
    """``segments`` of any length: a text's windows are taken ``most`` at a time, as anchors are numbered in 24 bits."""
    found = []
    for at in range(0, max(1, len(data) - length + 1), most):
        doc, first, count, h = segments(data[at : at + most + length - 1], ends - at, length)
        found.append((doc, first + at, count, h))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def _anchors(batches: Iterable[pa.RecordBatch], shards: int, length: int) -> Iterator[list]:
    for b in slices(batches, SLICE):
        uid = b.column(0).to_numpy()
        raws = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
        sizes = np.array([len(r) for r in raws], np.int64)
        ends = np.cumsum(sizes)
        doc, first, count, h = segments_of(np.frombuffer(b"".join(raws), np.uint8), ends, length)
        if not len(doc):
            continue
        start = first - (ends - sizes)[doc]
        shard = (h % np.uint64(shards)).astype(np.int64)
        span = shard << START_BITS + COUNT_BITS | start << COUNT_BITS | count
        _, lead, back, often = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        again = often[back] > 1
        direct = np.flatnonzero(again)  # needs no count, so any task will do
        to = shards + int(h[0] % np.uint64(shards))
        told = lead[often > 1]
        single = np.flatnonzero(~again)
        rows: list[list] = [[], [], [], []]

        def send(shard_: int, hashes: np.ndarray, own: np.ndarray) -> None:
            for column, x in zip(rows, (shard_, hashes.tobytes(), uid[doc[own]].tobytes(), span[own].tobytes()), strict=True):  # noqa: B023
                column.append(x)

        if len(direct):
            send(to, np.zeros(0, np.uint64), direct)
        for own, bare in ((single, False), (told, True)):
            own = own[np.argsort(shard[own], kind="stable")]
            edges = np.append(np.flatnonzero(np.diff(shard[own], prepend=-1)), len(own))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                send(int(shard[own[x]]), h[own[x:y]], own[:0] if bare else own[x:y])
        yield rows


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """(uid, span) of a shard's segments whose anchor occurs more than once.

    Rows have hashes with spans (anchors that are single in their slice), hashes alone (ones that are not) or
    spans alone (the latter's segments).
    """
    uid, at = (np.concatenate([np.frombuffer(x, np.int64) for x in group[c]]) for c in ("uid", "at"))
    with_span = [bool(len(a)) for a in group["at"]]
    alone = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x, w in zip(group["hash"], with_span, strict=True) if not w)])
    single = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x, w in zip(group["hash"], with_span, strict=True) if w)])
    counted = np.concatenate([np.full(len(a) // 8, bool(len(x))) for x, a in zip(group["hash"], group["at"], strict=True)])
    _, back, often = np.unique(single, return_inverse=True, return_counts=True)
    keep = np.ones(len(at), bool)
    keep[counted] = (often[back] > 1) | np.isin(single, alone) if len(single) else False
    return pd.DataFrame({"uid": uid[keep], "at": at[keep]})


class _Held:
    """Wanted segments of a task, equal ones reduced to the earliest."""

    def __init__(self):
        self.seen: dict[bytes, tuple] = {}
        self.more: list[tuple] = []
        self.gone: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, part: bytes, mine: tuple) -> None:
        known = self.seen.get(part)
        if known is None:
            self.seen[part] = mine
            self.size += len(part)
        elif mine[:2] == known[:2]:
            self.more.append((part, mine))
        else:
            early, late = (mine, known) if mine[:2] < known[:2] else (known, mine)
            self.seen[part] = early
            self.gone.append((late[3], late[0], late[2], late[1] << 8 | len(part)))

    def rows(self) -> list[list]:
        by_shard: dict[int, list] = {}
        for part, (doc, start, uid, shard) in [*self.seen.items(), *self.more]:
            by_shard.setdefault(shard, []).append((part, doc, uid, start))
        removed: dict[int, list] = {}
        for shard, doc, uid, v in self.gone:
            removed.setdefault(shard, []).append((uid, doc, v))
        rows: list[list] = [[] for _ in range(7)]
        for shard in by_shard.keys() | removed.keys():
            own = by_shard.get(shard, [])
            parts = [x[0] for x in own]
            number = lambda k, own=own: np.array([x[k] for x in own], np.int64).tobytes()
            values = (shard, b"".join(parts), np.array([len(x) for x in parts], np.int32).tobytes(), number(1), number(2), number(3), np.array(removed.get(shard, []), np.int64).tobytes())
            for column, x in zip(rows, values, strict=True):
                column.append(x)
        return rows


def _segment_rows(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[list]:
    """Bytes of the wanted segments by shard."""
    held = _Held()
    for b in slices(batches, SLICE):
        docs, uids, wanted = b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(3).to_pylist()
        for doc, uid, text, spans in zip(docs, uids, b.column(1).to_pylist(), wanted, strict=True):
            if not spans:
                continue
            raw = (text or "").encode("utf-8", "replace")
            for v in spans:
                start, count = v >> COUNT_BITS & (1 << START_BITS) - 1, v & (1 << COUNT_BITS) - 1
                part = raw[start : start + count - 1 + length]
                if len(part) == count - 1 + length:  # else another document of the same uid
                    held.add(part, (doc, start, uid, v >> START_BITS + COUNT_BITS))
        if held.size + 32 * len(held.gone) > HELD:
            yield held.rows()
            held = _Held()
    if held.seen:
        yield held.rows()


def _windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, first place) of a block: for each window the rank of its text, and for each rank where the joined parts have it."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    order = suffix_array(data)
    rank = np.empty(len(data), np.int64)
    rank[order] = np.cumsum(common_prefixes(data, order, length) < length)
    del order
    counts = sizes - length + 1
    place = np.arange(counts.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
    _, first, run = np.unique(rank[place], return_index=True, return_inverse=True)
    return run.astype(np.int32), place[first].astype(np.int32)


def _hashes(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """32 bits of a hash of each window."""
    words = _packed(data, little=True)
    h = np.zeros(len(place), np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = (h ^ words[place + k]) * _C1
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32)


def _in_two(blocks: list[np.ndarray]) -> np.ndarray:
    """Hashes that occur twice, ascending; a sixteenth of them at a time."""
    found = []
    for top in range(16):
        part = np.sort(np.concatenate([h[h >> np.uint32(28) == top] for h in blocks]))
        found.append(np.unique(part[1:][part[1:] == part[:-1]]))
    return np.concatenate(found)


def _located(data: np.ndarray, asked: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """For each asked window its index among the ascending windows at ``places``, -1 if it isn't there; by binary search."""
    table = np.lib.stride_tricks.sliding_window_view(data, length)

    def words(at: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(at), -(-length // 8) * 8), np.uint8)
        wide[:, :length] = table[at]
        return wide.view(">u8").astype(np.uint64)

    out = np.full(len(asked), -1, np.int64)
    for begin in range(0, len(asked), AT_ONCE):
        own = words(asked[begin : begin + AT_ONCE])
        row = np.arange(len(own))
        low, high = np.zeros(len(own), np.int64), np.full(len(own), len(places), np.int64)
        while (low < high).any():
            middle = np.minimum((low + high) // 2, len(places) - 1)
            there = words(places[middle])
            differ = there != own
            k = differ.argmax(axis=1)
            less = there[row, k] < own[row, k]
            open_ = low < high
            same = open_ & ~differ.any(axis=1)
            out[begin : begin + AT_ONCE][same] = middle[same]
            low = np.where(same, high, np.where(open_ & less, middle + 1, low))
            high = np.where(open_ & ~less & ~same, middle, high)
    return out


def removals(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of the windows that also start earlier, among distinct segments of one shard.

    Each block of ``block`` bytes gives its distinct windows in order. Windows of two blocks whose hashes are
    equal are looked up by binary search, comparing the texts themselves; equal ones take the earlier block's run.
    Some twelve bytes a window are held, beside one block's suffix array.
    """
    empty = np.zeros(0, np.int64)
    if not parts:
        return empty, empty
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begins, counts = np.cumsum(sizes) - sizes, sizes - length + 1
    edges = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // block, prepend=-1)), len(parts))
    runs, firsts, hashes, bases, total = [], [], [], [], 0
    for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        run, first = _windows(parts[a:e], length)
        at = int(begins[a])
        if len(edges) > 2:
            hashes.append(_hashes(data[at : at + int(sizes[a:e].sum())], first, length))
        runs.append(run), bases.append(total), firsts.append(first.astype(np.int64) + at if len(data) >> 31 else first + np.int32(at))
        total += len(first)
    to = np.arange(total, dtype=np.int32 if total >> 31 == 0 else np.int64)
    if hashes:
        shared = _in_two(hashes)
        own = [np.flatnonzero(shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h) if len(shared) else empty for h in hashes]
        del hashes
        for j in range(len(own)):
            left = own[j]
            for i in range(j):
                if len(left) and len(own[i]):
                    at = _located(data, firsts[j][left], firsts[i][own[i]], length)
                    hit = at >= 0
                    to[bases[j] + left[hit]] = to[bases[i] + own[i][at[hit]]]
                    left = left[~hit]
    run = np.concatenate([to[base + r] for base, r in zip(bases, runs, strict=True)])
    del runs, firsts, to
    first = np.full(total, -1, np.int32 if len(run) >> 31 == 0 else np.int64)
    first[run[::-1]] = np.arange(len(run), dtype=first.dtype)[::-1]
    often = np.zeros(total, bool)
    often[run[first[run] != np.arange(len(run), dtype=first.dtype)]] = True
    del first
    window = np.flatnonzero(often[run])
    run = run[window]
    ends = np.cumsum(counts)
    segment = np.searchsorted(ends, window, side="right")
    offset = window - (ends - counts)[segment]
    d, s = doc[segment], start[segment] + offset
    order = np.lexsort((s, d, run))
    r, d, s = run[order], d[order], s[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))[: len(r)]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(r) else empty
    gone = order[(d != d[lead]) | (s != s[lead])]
    return segment[gone], offset[gone]


def _shard(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """(uid, doc, span) removed, of one shard's segments."""
    seen: dict[bytes, int] = {}
    parts, doc, start, uids, spans = [], [], [], [], []
    for row in group.itertuples(index=False):
        if row.removed:
            spans.extend(np.frombuffer(row.removed, np.int64).reshape(-1, 3).tolist())
        numbers = zip(*(np.frombuffer(x, np.int64).tolist() for x in (row.doc, row.uid, row.start)), strict=True)
        at = 0
        for size, (d, u, s) in zip(np.frombuffer(row.size, np.int32).tolist(), numbers, strict=True):
            part = row.data[at : at + size]
            at += size
            k = seen.setdefault(part, len(parts))
            if k == len(parts):
                parts.append(part), doc.append(d), start.append(s), uids.append([u])
            elif (d, s) == (doc[k], start[k]):
                uids[k].append(u)
            elif (d, s) > (doc[k], start[k]):
                spans.append([u, d, s << 8 | size])
            else:
                spans.extend([x, doc[k], start[k] << 8 | size] for x in uids[k])
                doc[k], start[k], uids[k] = d, s, [u]
    docs, starts = np.array(doc, np.int64), np.array(start, np.int64)
    segment, offset = removals(parts, docs, starts, length)
    order = np.lexsort((offset, segment))
    segment, offset = segment[order], offset[order]
    new = np.concatenate(([True], (np.diff(segment) != 0) | (np.diff(offset) != 1)))[: len(segment)]
    first = np.flatnonzero(new)
    for k, o, n in zip(segment[first].tolist(), offset[first].tolist(), np.diff(np.append(first, len(segment))).tolist(), strict=True):
        spans.extend([u, doc[k], (start[k] + o) << 8 | (n - 1 + length)] for u in uids[k])
    table = np.array(spans, np.int64).reshape(-1, 3)
    return pd.DataFrame({"uid": table[:, 0], "doc": table[:, 1], "span": table[:, 2]})


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    for b in slices(batches, 4 << 20):
        out = []
        for uid, text, key, doc_id, found in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            raw = (text or "").encode("utf-8", "replace")
            spans: list[list[int]] = []
            for v in sorted(f["span"] for f in found or () if f["doc"] == key):
                a, e = v >> 8, (v >> 8) + (v & 255)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([a, e])
            edges = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc_id, text, len(raw), len(raw) - len(kept), len(spans), kept))
        yield [list(c) for c in zip(*out, strict=True)]


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, text, n_bytes, n_removed, n_spans and the kept bytes.

    A null text is empty. Rows that repeat a doc_id are the same document: at equal starts neither is
    earlier. A null doc_id comes after all others. Texts are taken as UTF-8; matches never cross documents.
    ``length`` is from 32 to 127, else a ValueError is raised; an empty table gives no rows. Other columns, of
    whatever name, are not read; texts have less than 2 GB, as Spark's strings do.
    """
    if not 32 <= length < 1 << COUNT_BITS:
        raise ValueError(f"length is {length}, not 32 to 127")
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    rows = rows.select(F.xxhash64("key", "text").alias("uid"), "text", "key", "doc_id")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # 2 ** 25 shards of SHARD bytes are 200 TB; over that, shards hold more
    shards = max(1, min(-(-total // SHARD), (1 << SHARD_BITS) - 1))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    anchors = map_rows(rows.select("uid", "text"), lambda b: _anchors(b, shards, length), ANCHORS)
    again = anchors.groupBy("shard").applyInPandas(_repeated, "uid long, at long")
    wanted = again.groupBy("uid").agg(F.collect_list("at").alias("wanted"))
    dealt = rows.repartition(parts, "uid")
    with_wanted = dealt.join(wanted, "uid").select("uid", "text", "key", "wanted", "doc_id")  # all of dealt's columns: its exchange is reused below
    bytes_of = map_rows(with_wanted, lambda b: _segment_rows(b, length), SEGMENTS)
    spans = bytes_of.groupBy("shard").applyInPandas(lambda g: _shard(g, length), SPANS)
    by_uid = spans.groupBy("uid").agg(F.collect_list(F.struct("doc", "span")).alias("found"))
    joined = dealt.join(by_uid, "uid", "left").select("uid", "text", "key", "doc_id", "found")
    return map_rows(joined, _kept, KEPT)


def report(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


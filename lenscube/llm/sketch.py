"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, long ones in pieces), whose digests go into three cells each of a
sketch: a count, an exclusive-or of digests and one of check values. The difference of two versions' sketches
holds only what differs; peeling cells that hold one digest recovers it. A fingerprint is a ladder of such
sketches: level k holds the digests whose hash ends in k zero bits, one in 2 ** (k + 1). From two fingerprints
alone, the levels from the top down to the first that is too full tell how many digests differ: exactly if all
can be peeled, else by what is left in their cells and scaled from a sample of the digests. Where a level fails and the digests themselves are wanted,
both texts are sketched again, larger and by other hashes, until peeling succeeds. Sketches of many documents are built
and peeled as one array.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lenscube.llm.common import map_rows

#: Characters of a paragraph; cells of a level of a fingerprint; levels at most; growth of the attempts at peeling.
PIECE, CELLS, LEVELS, GROWTH = 64, 30, 40, 4
#: Share of the cells of a failed level beyond which the rest doesn't tell how many digests it holds.
MOST_FULL = 0.5
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, gone binary, come binary, attempts int"


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed * int(_ODD) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _ODD
    return x ^ (x >> np.uint64(31))


def paragraphs(text: str) -> list[str]:
    """Lines in order, those over PIECE characters in pieces of it; empty lines are left out."""
    return [line[i : i + PIECE] for line in text.split("\n") for i in range(0, len(line), PIECE)]


def digests(text: str) -> np.ndarray:
    """A distinct number for each paragraph: the k-th of equal ones is told from the others."""
    d = np.fromiter((xxhash.xxh64_intdigest(p.encode("utf-8", "replace")) for p in paragraphs(text)), np.uint64)
    d.sort()
    if len(d) > 1 and (same := d[1:] == d[:-1]).any():
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        nth = np.arange(len(d)) - np.repeat(starts, np.diff(np.append(starts, len(d))))
        d = np.where(nth > 0, _mixed(d ^ nth.astype(np.uint64), 77), d)
    return d


class Cells:
    """Sketches of ``n`` sets, ``size`` cells each: counts, digests and checks."""

    def __init__(self, n: int, size: int, seed: int):
        self.part, self.seed, self.size = -(-size // 3), seed, 3 * -(-size // 3)
        self.count, self.key, self.check = np.zeros(n * self.size, np.int64), np.zeros(n * self.size, np.uint64), np.zeros(n * self.size, np.uint32)

    def _checks(self, keys: np.ndarray) -> np.ndarray:
        return _mixed(keys, 1000 + self.seed).astype(np.uint32)

    def toggle(self, owner: np.ndarray, keys: np.ndarray, sign: int | np.ndarray) -> None:
        checks = self._checks(keys)
        for k in range(3):
            at = owner * self.size + k * self.part + (_mixed(keys, 3 * self.seed + k + 1) % np.uint64(self.part)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, sign) of what could be recovered, and which owners failed; the cells are used up."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (self.check[look] == self._checks(self.key[look]))]
            if not len(pure):
                break
            pairs = np.stack([(pure // self.size).astype(np.uint64), self.key[pure]])
            pure = pure[np.unique(pairs, axis=1, return_index=True)[1]]
            owner, key, sign = pure // self.size, self.key[pure].copy(), self.count[pure].copy()
            found.append((owner, key, sign))
            self.toggle(owner, key, -sign)
            places = [owner * self.size + k * self.part + (_mixed(key, 3 * self.seed + k + 1) % np.uint64(self.part)).astype(np.int64) for k in range(3)]
            look = np.unique(np.concatenate(places))  # only cells that changed can have become pure
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        failed = left.reshape(-1, self.size).any(axis=1)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return (*(np.concatenate([f[k] for f in [*found, empty]]) for k in range(3)), failed)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.zeros(0, np.uint64)])


def levels(keys: np.ndarray) -> np.ndarray:
    """The level of each digest: the zero bits that its hash ends in."""
    h = _mixed(keys, 500)
    low = h & (~h + np.uint64(1))
    return np.minimum(np.bitwise_count(low - np.uint64(1)).astype(np.int64), LEVELS - 1)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """Each set's size and levels as text, up to its highest level; equal for equal sets, however they are batched."""
    owner, keys = _flat(sets)
    level = levels(keys)
    high = np.zeros(len(sets), np.int64)
    np.maximum.at(high, owner, level + 1)
    ends = np.cumsum(high)
    cells = Cells(int(ends[-1]) if len(ends) else 0, CELLS, 0)
    cells.toggle((ends - high)[owner] + level, keys, 1)
    out = []
    for s, e, h in zip(sets, (ends * cells.size).tolist(), (high * cells.size).tolist(), strict=True):
        own = slice(e - h, e)
        body = cells.count[own].astype("<i4").tobytes() + cells.key[own].astype("<u8").tobytes() + cells.check[own].astype("<u4").tobytes()
        out.append(base64.b64encode(len(s).to_bytes(8, "little") + zlib.compress(body, 1)).decode())
    return out


def compare(a: list[str], b: list[str]) -> list[tuple[int, int, int, np.ndarray | None, np.ndarray | None]]:
    """From fingerprints alone, for each pair: both sets' sizes, how many digests differ, and those of a and of b only.

    The last two are None where a level couldn't be peeled; the number is then an estimate.
    """
    bodies = [[base64.b64decode(f) for f in side] for side in (a, b)]
    totals = [[int.from_bytes(raw[:8], "little") for raw in side] for side in bodies]
    plain = [[zlib.decompress(raw[8:]) for raw in side] for side in bodies]
    width = 16 * Cells(0, CELLS, 0).size  # bytes of a level
    high = np.array([max(len(x), len(y)) // width for x, y in zip(*plain, strict=True)], np.int64).reshape(-1)
    ends = np.cumsum(high)
    cells = Cells(int(ends[-1]) if len(ends) else 0, CELLS, 0)
    for side, sign in zip(plain, (1, -1), strict=True):
        for raw, start in zip(side, ((ends - high) * cells.size).tolist(), strict=True):
            n = len(raw) // 16
            own = slice(start, start + n)
            cells.count[own] += sign * np.frombuffer(raw, "<i4", n)
            cells.key[own] ^= np.frombuffer(raw, "<u8", n, 4 * n)
            cells.check[own] ^= np.frombuffer(raw, "<u4", n, 12 * n)
    owner, key, sign, failed = cells.peel()
    order = np.argsort(owner, kind="stable")
    owner, key, sign = owner[order], key[order], sign[order]
    found = np.bincount(owner, minlength=len(failed)) if len(failed) else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(found)))
    # what a failed level still holds, by the share of its cells that are not empty; none where most are not
    full = ((cells.count != 0) | (cells.key != 0)).reshape(-1, 3, cells.part).mean(axis=2)
    held = np.where(full.max(axis=1, initial=0) <= MOST_FULL, found + (np.log1p(-np.minimum(full, 0.99)) / np.log1p(-1 / cells.part)).mean(axis=1), -1.0)
    held = np.where(failed, held, found)
    out = []
    for i, (e, h) in enumerate(zip(ends.tolist(), high.tolist(), strict=True)):
        bad = np.flatnonzero(held[e - h : e] < 0)
        low = int(bad[-1]) + 1 if len(bad) else 0  # the lowest level from which on all levels tell their number
        differ = round(float(held[e - h + low : e].sum())) << low
        x, y = totals[0][i], totals[1][i]
        if not failed[e - h : e].any():
            keys_, signs = key[at[e - h] : at[e]], sign[at[e - h] : at[e]]
            out.append((x, y, differ, np.sort(keys_[signs > 0]), np.sort(keys_[signs < 0])))
        else:
            out.append((x, y, x + y if low == h else min(max(differ, abs(x - y), 1), x + y), None, None))
    return out


def likeness(a: int, b: int, differing: int) -> float:
    """Shared among all distinct digests of two sets of ``a`` and ``b``, 0 to 1; two empty ones are alike."""
    return (a + b - differing) / (a + b + differing) if a + b else 1.0


def near(a: list[str], b: list[str]) -> list[float]:
    """The likeness of fingerprints, from nothing but the fingerprints."""
    return [likeness(*x[:3]) for x in compare(a, b)]


def differences(a: list[np.ndarray], b: list[np.ndarray], sizes: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(digests of a[i] only, of b[i] only, attempts): sketched, subtracted and peeled, larger until it succeeds.

    A sketch of more cells than digests can be peeled but for rare accidents, and each attempt takes other
    hashes, so the attempts end.
    """
    out: list = [None] * len(a)
    open_ = [(i, CELLS if sizes is None else max(CELLS, sizes[i]), 1) for i in range(len(a))]
    while open_:
        again = []
        for i, size, attempt in open_:
            cells = Cells(1, size, attempt)
            for keys, sign in ((a[i], 1), (b[i], -1)):
                cells.toggle(np.zeros(len(keys), np.int64), keys, sign)
            _, key, sign, failed = cells.peel()
            if failed[0]:
                again.append((i, size * GROWTH, attempt + 1))
            else:
                out[i] = (np.sort(key[sign > 0]), np.sort(key[sign < 0]), attempt)
        open_ = again
    return out


def _compared(rows: list[tuple[int | None, str, str]]) -> list[list]:
    """Columns of the result for (doc_id, text, next text)."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in rows]
    own, new = [digests(t) for _, t, _ in rows], [digests(e) for e in edited]
    after = {i: digests(n) for i, (_, _, n) in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][1] is not n}
    own_prints, new_prints = fingerprints(own), fingerprints(new)
    odd = dict(zip(after, fingerprints(list(after.values())), strict=True))
    next_prints = [odd[i] if i in odd else own_prints[i + 1] for i in range(len(rows))]
    found = compare(own_prints, new_prints)
    open_ = [i for i, x in enumerate(found) if x[3] is None]
    larger = differences([own[i] for i in open_], [new[i] for i in open_], [2 * found[i][2] for i in open_])
    changed = [(x[3], x[4], 0) for x in found]
    for i, x in zip(open_, larger, strict=True):
        changed[i] = x
    return [
        [d for d, _, _ in rows], [len(t) for _, t, _ in rows], [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited],
        own_prints, new_prints, [likeness(*x[:3]) for x in found], near(own_prints, next_prints),
        [x.astype("<u8").tobytes() for x, _, _ in changed], [y.astype("<u8").tobytes() for _, y, _ in changed], [n for _, _, n in changed],
    ]


def _streamed(batches) -> Iterator[list[list]]:
    """Rows (bucket, tail, doc_id, text) in order; each own row meets the row after it in its bucket."""
    last, rows, held = None, [], 0
    for b in batches:
        for bucket, tail, doc_id, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if last and last[0] == bucket and not last[1]:
                rows.append((last[2], last[3], text))
                held += len(last[3])
                if held > 2 << 20:
                    yield _compared(rows)
                    rows, held = [], 0
            last = (bucket, tail, doc_id, text)
    if rows:
        yield _compared(rows)


def _layout(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct bounds, buckets of each bound's own key, first bucket of each range) of quantiles.

    A key that is several quantiles holds so many buckets' rows: it gets as many of its own, by hash of the text.
    """
    distinct, times = np.unique(bounds, return_counts=True)
    own = np.where(times > 1, times, 0)
    return distinct, own, np.concatenate(([0], np.cumsum(1 + own)))


def _buckets(keys: np.ndarray, hashes: np.ndarray, layout: tuple) -> np.ndarray:
    """The bucket of each row by its key and, for a key with buckets of its own, its hash; buckets ascend with both."""
    distinct, own, first = layout
    j = np.searchsorted(distinct, keys, side="left")
    bucket = first[j]
    if len(distinct):
        k = np.minimum(j, len(distinct) - 1)
        hot = (distinct[k] == keys) & (own[k] > 0)
        share = ((hashes ^ np.int64(-(1 << 63))).view(np.uint64) >> np.uint64(32)).astype(np.int64) * own[k] >> 32
        bucket = np.where(hot, bucket + 1 + share, bucket)
    return bucket.astype(np.int32)


def against_next(docs: DataFrame, per_bucket: int = 1024) -> DataFrame:
    """Each document against its edited text and against the next document, by descending doc_id.

    Likeness is that of the fingerprints (``near``); ``gone`` and ``come`` are the digests (8 bytes each) that only
    the text and only its edited text have, recovered by peeling, after ``attempts`` larger sketches where the
    fingerprints' own could not be peeled. Null texts are empty; null ids come last; rows that repeat a doc_id
    follow by hash of the text. The only document follows itself; an empty table gives no rows. Texts of any
    length are taken whole. Other columns,
    of whatever name, are not read. Documents are dealt into ranges of ids by approximate quantiles, and rows of one
    id that fill several ranges (null ids, too) by their texts' hashes; the first document of a range goes to the
    range before as well, so one shuffle serves.
    """
    key = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))  # ascends as ids descend
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.select(key.alias("key"))
    n = ids.count()
    buckets = max(1, -(-n // max(per_bucket, n // 100_000)))  # what the driver gathers stays bounded
    at = [k / buckets for k in range(1, buckets)]
    layout = _layout(np.array(ids.agg(F.percentile_approx("key", at, 10 * buckets)).first()[0] or [], np.int64) if at else np.zeros(0, np.int64))
    hot = layout[0][layout[1] > 0]

    @F.pandas_udf("boolean")
    def is_hot(k: pd.Series) -> pd.Series:
        return pd.Series(np.isin(k.to_numpy(), hot))

    @F.pandas_udf("int")
    def bucket_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_buckets(k.to_numpy(), h.to_numpy(), layout))

    def keyed(*more) -> DataFrame:  # the text is read for its hash only where a key is hot
        part = F.when(is_hot(key), F.xxhash64(text)).otherwise(F.lit(0).cast("long")) if len(hot) else F.lit(0).cast("long")
        return docs.select(key.alias("key"), part.alias("part"), *more)

    heads_of = keyed().groupBy(bucket_of("key", "part").alias("bucket")).agg(F.min(F.struct("key", "part")).alias("head")).collect()
    firsts = sorted((r.bucket, r.head.key, r.head.part) for r in heads_of)
    goes = {(k, h): firsts[i - 1][0] for i, (_, k, h) in enumerate(firsts)}  # one entry a range; the very first to the last

    @F.pandas_udf("array<int>")
    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        own = _buckets(k.to_numpy(), h.to_numpy(), layout).tolist()
        return pd.Series([[o, goes[x]] if (x := (a, b)) in goes else [o] for o, a, b in zip(own, k.tolist(), h.tolist(), strict=True)])

    rows = keyed(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    dealt = rows.select("key", "hash", "doc_id", "text", F.posexplode(places("key", "part")).alias("tail", "bucket"))
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", "key", "hash", "text")
    return map_rows(ordered.select("bucket", "tail", "doc_id", "text"), _streamed, RESULT)


def report(compared: DataFrame) -> DataFrame:
    """The comparisons with counts in place of the recovered digests."""
    counts = [(F.octet_length(c) / 8).cast("long").alias(f"n_{c}") for c in ("gone", "come")]
    return compared.select(*[c for c in compared.columns if c not in ("gone", "come")], *counts)

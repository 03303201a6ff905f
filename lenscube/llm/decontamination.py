"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by documents: a segment holds the postings (term -> ascending token positions) of a
bounded run of documents, written once to the shared checkpoint folder. A search takes the test items in
bounded blocks to every segment. There each window of an item starts from its rarest term in the segment: that
term's postings, shifted by the term's offset, are intersected with the postings of the terms around it, all windows
at once. Items are also looked for by proximity: their longest words near each other. Nothing is shuffled for one
block; more blocks are searched one after the other and meet by the row's place in the index.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lenscube.llm.common import cut, docs_of, map_rows, slices

#: Bytes that are no part of a word: ASCII but for digits and letters. Capitals become small letters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SEGMENT = "doc_ids binary, known binary, ends binary, terms binary, counts binary, postings binary, segment binary"
HITS = "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>, near array<string>"
#: A row of the index: its segment and its position there.
PLACE = "segment binary, position long"
#: Words of an item that a proximity match asks for, and how far from the first of them the others may lie.
NEAR_WORDS, WITHIN = 6, 30
#: Postings that are followed at a time.
AT_ONCE = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: runs of letters, digits and anything beyond ASCII, with A-Z lowered."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype, n: int) -> np.ndarray:
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), dtype) if size else np.zeros(0, dtype)


def segment(ids: list[int | None], texts: list[str | None]) -> tuple:
    """One row of the index."""
    words, ends = [], []
    for text in texts:
        words.extend(words_of(text))
        ends.append(len(words))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    order = np.argsort(codes, kind="stable").astype(np.int64)
    counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.uint32)
    steps = np.diff(order, prepend=0)
    if len(order):
        firsts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)[:-1]))
        steps[firsts] = order[firsts]
    known = np.array([d is not None for d in ids], np.uint8)
    return (
        np.array([d or 0 for d in ids], np.int64).tobytes(), known.tobytes(), np.array(ends, np.int64).tobytes(),
        pa.compress(b"\n".join(coded.dictionary.to_pylist()), codec="zstd", asbytes=True) if len(counts) else b"",
        len(b"\n".join(coded.dictionary.to_pylist())).to_bytes(8, "little") + counts.tobytes(), _packed(steps.astype(np.uint32)),
    )


def index(docs: DataFrame, segment_bytes: int = 4 << 20) -> DataFrame:
    """The stored index: every token of every document, nulls as documents without words; segments have keys of their own."""

    def run(batches):
        for b in slices(batches, segment_bytes):
            yield [*([x] for x in segment(b.column(0).to_pylist(), b.column(1).to_pylist())), [uuid.uuid4().bytes]]

    return cut(map_rows(docs_of(docs), run, SEGMENT))


class Postings:
    """A segment read back: ``order`` has the positions by term, ``to`` where each term's end, ``codes`` the term of each position."""

    def __init__(self, row: dict):
        self.known = np.frombuffer(row["known"], np.uint8)
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.ends = np.frombuffer(row["ends"], np.int64)
        size, counts = int.from_bytes(row["counts"][:8], "little"), np.frombuffer(row["counts"][8:], np.uint32)
        names = pa.decompress(row["terms"], decompressed_size=size, codec="zstd", asbytes=True).split(b"\n") if len(counts) else []
        self.at = {w: k for k, w in enumerate(names)}
        self.counts = counts.astype(np.int64)
        self.to = np.cumsum(self.counts)
        n = int(self.to[-1]) if len(counts) else 0
        run = np.cumsum(_unpacked(row["postings"], np.uint32, n), dtype=np.int64)
        begins = self.to - self.counts
        before = np.concatenate(([0], run))[begins] if len(counts) else begins
        self.order = run - np.repeat(before, self.counts)
        self.codes = np.empty(n, np.int32)
        self.codes[self.order] = np.repeat(np.arange(len(counts), dtype=np.int32), self.counts)
        self.doc = np.searchsorted(self.ends, np.arange(n), side="right").astype(np.int32)

    def terms_of(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """The segment's number of each word of a vocabulary, -1 for one that it hasn't."""
        out = np.full(len(vocabulary), -1, np.int64)
        small, large = (self.at, vocabulary) if len(self.at) < len(vocabulary) else (vocabulary, self.at)
        both = [w for w in small if w in large]
        out[[vocabulary[w] for w in both]] = [self.at[w] for w in both]
        return out

    def occurring(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many of each term's positions lie from ``low`` up to before ``high``."""
        n = len(self.codes) + 1
        keys = self.__dict__.setdefault("keys", np.repeat(np.arange(len(self.counts)), self.counts) * n + self.order)
        return np.searchsorted(keys, terms * n + high) - np.searchsorted(keys, terms * n + low)

    def postings(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into ``terms``, position) of all their postings, AT_ONCE and one term at a time."""
        sizes = self.counts[terms]
        number = np.cumsum(sizes) // AT_ONCE
        for k in np.unique(number):
            own = np.flatnonzero(number == k)
            each = sizes[own]
            which = np.repeat(own, each)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            yield which, self.order[(self.to[terms] - sizes)[which] + inside]


class Items:
    """Test items as arrays: their words in a row, and for each item its window's length and words for proximity."""

    def __init__(self, rows: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        self.words = np.array([number.setdefault(w, len(number)) for _, words in rows for w in words], np.int32)
        sizes = np.array([len(words) for _, words in rows], np.int64)
        self.ends = np.cumsum(sizes)
        self.item = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        self.window = np.minimum(sizes, window)
        self.near = np.full((len(rows), NEAR_WORDS), -1, np.int32)
        for k, (_, words) in enumerate(rows):
            chosen = sorted(set(words), key=lambda w: (-len(w), w))[:NEAR_WORDS]
            self.near[k, : len(chosen)] = [number[w] for w in chosen]

    def found(self, p: Postings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first position, end) of the runs of words in which windows of an item occur."""
        none = np.zeros(0, np.int64)
        out = []
        code = p.terms_of(self.vocabulary)[self.words]  # the item's words by the segment's numbers
        size = np.where(code >= 0, p.counts[np.maximum(code, 0)] if len(p.counts) else 0, 0)
        for length in np.unique(self.window):
            starts = np.flatnonzero((self.window[self.item] == length) & (np.arange(len(code)) + length <= self.ends[self.item]))
            # the rarest term of each window, by a running minimum over its offsets
            rarest = starts.copy()
            for k in range(1, int(length)):
                rarest = np.where(size[starts + k] < size[rarest], starts + k, rarest)
            anchors = np.unique(rarest[size[rarest] > 0])
            for which, at in p.postings(code[anchors]):
                anchor = anchors[which]
                out.append(self._runs(p, code, anchor, at, int(length)))
        return tuple(np.concatenate([none, *(x[k] for x in out)]) for k in range(3))

    def _runs(self, p: Postings, code: np.ndarray, anchor: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Of anchors that meet postings, the runs of equal words around them that hold a window."""
        reach = {}
        for step in (1, -1):
            run = np.zeros(len(at), np.int64)
            open_ = np.arange(len(at))
            for d in range(1, length):
                a, b = anchor[open_] + step * d, at[open_] + step * d
                inside = (a >= 0) & (a < len(code)) & (b >= 0) & (b < len(p.codes))
                open_, a, b = open_[inside], a[inside], b[inside]
                same = (code[a] == p.codes[b]) & (self.item[a] == self.item[anchor[open_]]) & (p.doc[b] == p.doc[at[open_]])
                open_ = open_[same]
                run[open_] = d
                if not len(open_):
                    break
            reach[step] = run
        whole = np.flatnonzero(reach[1] + reach[-1] + 1 >= length)
        return self.item[anchor[whole]].astype(np.int64), at[whole] - reach[-1][whole], at[whole] + reach[1][whole] + 1

    def close(self, p: Postings, within: int = WITHIN) -> tuple[np.ndarray, np.ndarray]:
        """(item, document) where all of an item's words for proximity lie at most ``within`` words from its longest."""
        terms = p.terms_of(self.vocabulary)
        code = np.where(self.near >= 0, terms[np.maximum(self.near, 0)] if len(terms) else -1, -2)
        held = np.flatnonzero((code != -1).all(axis=1) & (code[:, 0] >= 0)) if len(code) else np.zeros(0, np.int64)
        begins = np.concatenate(([0], p.ends[:-1]))[: len(p.ends)]
        out = [np.zeros((2, 0), np.int64)]
        for which, at in p.postings(code[held, 0]):
            item, doc = held[which], p.doc[at].astype(np.int64)
            for k in range(1, NEAR_WORDS):
                term = code[item, k]
                low, high = np.maximum(at - within, begins[doc]), np.minimum(at + within + 1, p.ends[doc])
                keep = (term == -2) | (p.occurring(np.maximum(term, 0), low, high) > 0)
                item, doc, at = item[keep], doc[keep], at[keep]
            out.append(np.unique(np.stack([item, doc]), axis=1))
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return found[0], found[1]


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(name, words) of the test items, streamed through the driver in blocks of at most about ``most`` bytes and one item.

    A word counts as what it takes in ``Items``: 24 bytes, and 100 and its letters where it is new to the block.
    """
    block, size, seen = [], 0, set()
    for name, body in items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        if name is not None and (words := words_of(body)):
            block.append((name, words))
            new = set(words) - seen
            seen |= new
            size += 24 * len(words) + sum(100 + len(w) for w in new)
            if size >= most:
                yield block
                block, size, seen = [], 0, set()
    if block:
        yield block


def search(postings: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Per row of the index: n_words, merged hit spans in words, the items with occurring windows, and the items near.

    Exact for any number of items: they go out in blocks of bounded size, and blocks meet by row, so that rows
    which repeat a doc_id or have none stay apart; a block's rows with hits are written before the next block
    goes out. Items that are null, have a null id or no words match nothing; items that repeat an id are one
    item. An item is near where its NEAR_WORDS longest words lie WITHIN words of the longest, in one document.
    """
    context, blocks = postings.sparkSession.sparkContext, _blocks(items, item_id, text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)

    def searched(block: list, every: bool) -> tuple[DataFrame, Broadcast]:
        shared = context.broadcast(Items(block, window))  # of about block_bytes
        return map_rows(postings, lambda batches: _found(batches, shared.value, every), f"{HITS}, {PLACE}"), shared

    if second is None:
        return searched(first, True)[0].drop("segment", "position")
    parts = []
    for k, block in enumerate(itertools.chain((first, second), blocks)):
        found, shared = searched(block, k == 0)
        parts.append(cut(found))
        shared.destroy()
    found = reduce(DataFrame.unionAll, parts)
    lists = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")]
    merged = found.groupBy("segment", "position").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), *lists)
    return map_rows(merged.drop("segment", "position"), _merged, HITS)


def proximity(postings: DataFrame, phrases: list[str], within: int) -> DataFrame:
    """(doc_id, phrase, position): where a phrase's first word has all its words at most ``within`` words away.

    A word that the phrase repeats must occur as often, the first one's own place included. ``phrases`` is a
    short list of queries; positions count a document's words from 0; nothing crosses a document's end.
    """
    asked = [(p, Counter(words_of(p)), words_of(p)[0]) for p in phrases if words_of(p)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            for row in b.to_pylist():
                p = Postings(row)
                begins = np.concatenate(([0], p.ends[:-1]))
                out = []
                for phrase, terms, first in asked:
                    if any(t not in p.at for t in terms):
                        continue
                    (at,) = (x for _, x in p.postings(np.array([p.at[first]])))
                    for t, often in sorted(terms.items(), key=lambda x: p.counts[p.at[x[0]]]):  # the rarest first
                        doc = p.doc[at]
                        low, high = np.maximum(at - within, begins[doc]), np.minimum(at + within + 1, p.ends[doc])
                        at = at[p.occurring(np.full(len(at), p.at[t]), low, high) >= often]
                    for x in at.tolist():
                        d = int(p.doc[x])
                        out.append((int(p.ids[d]) if p.known[d] else None, phrase, x - int(begins[d])))
                if out:
                    yield [list(c) for c in zip(*out, strict=True)]

    return map_rows(postings, run, "doc_id long, phrase string, position long")


def _merged(batches: Iterable[pa.RecordBatch]):
    for b in batches:
        hits = [[{"start": s, "end": e} for s, e in joined([(h["start"], h["end"]) for h in row])] for row in b.column(2).to_pylist()]
        yield [b.column(0), b.column(1), hits, b.column(3), b.column(4)]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint, sorted ones."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _found(batches: Iterable[pa.RecordBatch], asked: Items, every: bool) -> Iterator[list]:
    """Rows of HITS and PLACE: of every document, or of those with a match."""
    for b in batches:
        for row in b.to_pylist():
            p = Postings(row)
            n = len(p.ends)
            begins = np.concatenate(([0], p.ends[:-1]))[:n]
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            near: dict[int, set] = {}
            for item, start, end in zip(*(x.tolist() for x in asked.found(p)), strict=True):
                d = int(p.doc[start])
                spans.setdefault(d, []).append((start - int(begins[d]), end - int(begins[d])))
                items.setdefault(d, set()).add(asked.names[item])
            for item, d in zip(*(x.tolist() for x in asked.close(p)), strict=True):
                near.setdefault(d, set()).add(asked.names[item])
            docs = range(n) if every else sorted(items.keys() | near.keys())
            sizes = (p.ends - begins).tolist()
            yield [
                [int(p.ids[d]) if p.known[d] else None for d in docs], [sizes[d] for d in docs],
                [[{"start": s, "end": e} for s, e in joined(spans.get(d, []))] for d in docs],
                [sorted(items.get(d, ())) for d in docs], [sorted(near.get(d, ())) for d in docs], [row["segment"]] * len(docs), list(docs),
            ]


def report(found: DataFrame) -> DataFrame:
    """Counts and digests per document."""
    return found.select(
        "doc_id", "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """The documents in which no window of an item occurs, all columns, of whatever names, as they were.

    Null and empty texts stay, rows that repeat are each by itself, an empty table gives no rows. Blocks of items
    are filters one after the other, each on an index of the batch at hand, so that no text is shuffled or written.
    """
    for block in _blocks(items, item_id, text, block_bytes):
        docs = docs.where(~_hit_by(docs.sparkSession.sparkContext.broadcast(Items(block, window)))(F.col(text)))
    return docs


def _hit_by(wanted: Broadcast):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        found: list[bool] = []
        rows = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        for b in slices([rows], 4 << 20):
            found.extend(_hit(b.column(1).to_pylist(), wanted.value))
        return pd.Series(found, dtype=bool)

    return hit


def _hit(texts: list[str | None], wanted: Items) -> list[bool]:
    p = Postings(dict(zip(("doc_ids", "known", "ends", "terms", "counts", "postings"), segment([0] * len(texts), texts), strict=True)))
    out = np.zeros(len(texts), bool)
    out[p.doc[wanted.found(p)[1]]] = True
    return out.tolist()

"""Near-duplicates by SimHash and tiled exact comparison.

Equal fingerprints are one node. Nodes meet in groups of about GROUP, and there tiles of them, sorted by population
count, are compared whole by exclusive-or and bit counts; tile pairs whose population counts differ by more
than the radius are passed over. A group is the fingerprints that agree on some bits (``masks``: two within the
radius agree on the bits of one mask at least) and whose population counts lie in one band or the next, so that
no pair within the radius is lost. A group over SPLIT nodes is dealt to a task for each pair of its parts. A
task yields the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lenscube.llm.common import columns_of, cut, map_rows, slices, whole_row
from lenscube.llm.components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Fingerprints of a tile, aimed at in a group, and of a part of a group at most.
TILE, GROUP, SPLIT = 256, 1024, 16384
#: Documents whose shingle sets a part of a component has.
PART = 512
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x165667B19E3779F9 % (1 << 64))) * _MIX
    return (x ^ (x >> np.uint64(31))) * _ODD


def hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split(b" ")
    if b"" in words:
        words = [w for w in words if w]
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The majority of the hash bits of the text's word shingles, repeats included; 0 without words."""
    return majority(hashes(text, width, seed))


def _names(prints: int) -> list[str]:
    return ["bits", *(f"bits_{k}" for k in range(1, prints))]


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, prints: int = 1, **more: Column) -> DataFrame:
    """(doc_id, bits long): the fingerprint's 64 bits as a signed number; ``more`` are long columns to go with it.

    With several ``prints``, bits_1 and on are fingerprints of the same hashes mixed anew. A null text has no words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(n) for n, c in more.items()])
    extra = len(more)

    def run(batches):
        for b in slices(batches, 8 << 20):
            values = np.zeros((b.num_rows, prints), np.uint64)
            for i, text in enumerate(b.column(1).to_pylist()):
                h = hashes(text, width, seed)
                values[i] = [majority(_mixed(h, k) if k else h) for k in range(prints)]
            yield [b.column(0), *values.T.copy().view(np.int64), *(b.column(2 + k) for k in range(extra))]

    return map_rows(rows, run, ", ".join(["doc_id long", *(f"{n} long" for n in [*_names(prints), *more])]))


def masks(n: int, radius: int, group: int = GROUP) -> list[int]:
    """Masks of bits for groups of about ``group`` of ``n`` fingerprints.

    Of radius + m blocks of the 64 bits, two fingerprints within the radius agree on m at least; a mask has some
    bits of m blocks each. m is the least that gives enough bits. Few fingerprints are one group.
    """
    bits = max(0, (n - 1) // group).bit_length()
    if not bits:
        return [0]
    for m in range(1, 65 - radius):
        edges = [64 * k // (radius + m) for k in range(radius + m + 1)]
        each = -(-bits // m)
        if min(b - a for a, b in itertools.pairwise(edges)) >= each:
            break
    else:
        m, each = 64 - radius, 1
    blocks = [((1 << each) - 1) << a for a in edges[:-1]]
    return [sum(c) for c in itertools.combinations(blocks, m)]


def keys(bits: np.ndarray, radius: int, mask: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The key of each fingerprint's own group, and of the one below, whose band of population counts is one less."""
    band = np.bitwise_count(bits).astype(np.uint64) // np.uint64(radius + 1)
    group = _mixed(bits & np.uint64(mask), mask % 1_000_003 + 1 + salt * 1_000_003)
    return _mixed(group + band, 7), _mixed(group + band - np.uint64(1), 7)


class Forest:
    """A spanning forest of all pairs within the radius that are compared, by tiles."""

    def __init__(self, bits: np.ndarray, radius: int, tile: int = TILE):
        self.bits, self.radius, self.tile = bits, radius, tile
        self.count, self.root = np.bitwise_count(bits).astype(np.int64), np.arange(len(bits))
        self.edges: list[tuple[int, int]] = []
        self.compared = self.skipped = 0

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def tiles(self, own: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """Tiles of the positions ``own`` by population count, with their least and largest."""
        own = own[np.argsort(self.count[own], kind="stable")]
        return [(x := own[a : a + self.tile], int(self.count[x[0]]), int(self.count[x[-1]])) for a in range(0, len(own), self.tile)]

    def compare(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """All pairs of ``left``, or those of ``left`` with ``right``."""
        rows = self.tiles(left)
        columns = rows if right is None else self.tiles(right)
        for k, (a, low, high) in enumerate(rows):
            for b, least, most in columns[k:] if right is None else columns:
                if least - high > self.radius or low - most > self.radius:
                    self.skipped += 1
                    continue
                self.compared += 1
                roots = self.root[a]
                if roots[0] == self.root[b[0]] and (roots == roots[0]).all() and (self.root[b] == roots[0]).all():
                    continue  # connected already
                near = np.bitwise_count(self.bits[a][:, None] ^ self.bits[b][None, :]) <= self.radius
                i, j = np.nonzero(np.triu(near, 1) if a is b else near)
                self.join(a[i], b[j])

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            apart = root[i] != root[j]  # cheap first look; find() decides
            i, j = i[apart], j[apart]
            for x, y in zip(i[: self.tile].tolist(), j[: self.tile].tolist(), strict=True):
                if (p := self.find(x)) != (q := self.find(y)):
                    root[max(p, q)] = min(p, q)
                    self.edges.append((x, y))
            if len(i):
                while (up := root[root] != root).any():
                    root[up] = root[root[up]]
            i, j = i[self.tile :], j[self.tile :]


def _compared(bits: np.ndarray, part: np.ndarray, below: np.ndarray, radius: int, counter: Accumulator | None) -> list[tuple[int, int]]:
    """Edges of one task: the pairs of its two parts, or of its only one, but for pairs that both came from the next band."""
    forest = Forest(bits, radius)
    parts = np.unique(part)
    own = [(np.flatnonzero((part == p) & ~below), np.flatnonzero((part == p) & below)) for p in parts]
    if len(own) == 1:
        forest.compare(own[0][0])
        forest.compare(*own[0])
    else:
        for left, right in ((own[0][0], own[1][0]), (own[0][0], own[1][1]), (own[1][0], own[0][1])):
            forest.compare(left, right)
    if counter is not None:
        counter.add(forest.compared)
    return forest.edges


def _keyed(batches: Iterable[pa.RecordBatch], radius: int, wanted: list[int]) -> Iterator[list]:
    for b in batches:
        node = b.column(0).to_numpy()
        for k, mask in itertools.product(range(b.num_columns - 1), wanted):
            bits = b.column(1 + k).to_numpy().view(np.uint64)
            own, under = keys(bits, radius, mask, k)
            yield [np.concatenate([own, under]).view(np.int64), np.tile(node, 2), np.tile(bits.view(np.int64), 2), np.repeat([0, 1], len(node))]


def _dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    """(task, node, bits, below, part): a row of a group of several parts goes to a task for each pair of its own and another."""
    for b in batches:
        key, node, bits, below, size = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        parts = np.where(np.isnan(size), 1, -(-np.nan_to_num(size) // SPLIT)).astype(np.int64) if size.dtype.kind == "f" else -(-size // SPLIT)
        own = (_mixed(bits.view(np.uint64), 11) % parts.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(key)), parts)
        other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        mine = own[at]
        task = _mixed(key[at].view(np.uint64) + (np.minimum(mine, other) << 20 | np.maximum(mine, other)).view(np.uint64), 13)
        yield [task.view(np.int64), node[at], bits[at], below[at], mine]


def links(nodes: DataFrame, radius: int = 3, counter: Accumulator | None = None) -> DataFrame:
    """Edges (u, v) of nodes (node long, bits long) that connect what lies within the radius.

    Columns after the first are fingerprints; nodes link by any of them. Nodes may share a fingerprint.
    ``counter`` gets the number of tile pairs that all tasks compare.
    """
    wanted = masks(nodes.count(), radius)

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def tasks(table: pa.Table) -> list:
            task, node, bits, below, part = (table.column(k).to_numpy() for k in range(5))
            edges = np.append(np.flatnonzero(np.diff(task, prepend=task[0] - 1)), len(task))
            u, v = [], []
            for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e - a > 1:
                    for x, y in _compared(bits[a:e].view(np.uint64), part[a:e], below[a:e] > 0, radius, counter):
                        u.append(node[a + x]), v.append(node[a + y])
            return [np.array(u, np.int64), np.array(v, np.int64)]

        for b in batches:  # sorted by task; the last one may go on in the next batch
            if not b.num_rows:
                continue
            task = b.column(0).to_numpy()
            if task[0] == task[-1]:
                held.append(b)
                continue
            last = int(np.searchsorted(task, task[-1]))
            yield tasks(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = [b.slice(last)]
        if held:
            yield tasks(pa.Table.from_batches(held))

    keyed = map_rows(nodes, lambda b: _keyed(b, radius, wanted), "key long, node long, bits long, below int")
    large = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > SPLIT)
    sized = keyed.join(large, "key", "left").select("key", "node", "bits", "below", F.coalesce("size", F.lit(1)).alias("size"))
    dealt = map_rows(sized, _dealt, "task long, node long, bits long, below int, part long")
    alone = dealt.repartition("task").sortWithinPartitions("task")
    return map_rows(alone, compare, "u long, v long").distinct()


def _nodes(prints: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node and fingerprints, one of each kind; edges between the nodes that rows of one doc_id have)."""
    nodes = cut(prints.where("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("node")).select("node", *names))
    ends = prints.join(nodes, names).groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("u"))
    return nodes, ends.where("u != v").select("u", "v")


def _with_component(prints: DataFrame, nodes: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """``prints`` (doc_id, the fingerprints named, more) with component_id."""
    by_bits = nodes.join(components(edges), "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    return prints.join(by_bits, names, "left")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42, counter: Accumulator | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in ``radius`` bits at most; component_id is the smallest
    doc_id reachable. Documents without words (null, empty, white space) have fingerprint zero and link like
    any other. Rows that repeat a doc_id with other texts tie their components together; a null doc_id is
    left out of links. An empty table gives no rows. Other columns, of whatever name, are not read. A text of
    any length is hashed whole.
    """
    prints = cut(fingerprints(docs, width, seed))
    nodes, repeated = _nodes(prints, _names(1))
    found = _with_component(prints, nodes, links(nodes, radius, counter).unionAll(repeated), _names(1))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[list]:
    """(task, node, part, grams): a document's shingle set for each task that its part of the component has."""
    for b in slices(batches, 2 << 20):
        rows: list[list] = [[], [], [], []]
        for node, text, component, size in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            grams = np.unique(hashes(text, width).astype(np.uint32)).tobytes()
            parts = -(-size // PART)
            mine = int(_mixed(np.array([node], np.int64).view(np.uint64), 17)[0] % np.uint64(parts))
            other = np.arange(parts, dtype=np.int64)
            pair = (np.minimum(mine, other) << 20 | np.maximum(mine, other)).view(np.uint64)
            tasks = _mixed(np.array([component], np.int64).view(np.uint64) * _ODD + pair, 19).view(np.int64).tolist()
            for column, values in zip(rows, (tasks, [node] * parts, [mine] * parts, [grams] * parts), strict=True):
                column.extend(values)
            if len(rows[0]) > 4096:
                yield rows
                rows = [[], [], [], []]
        if rows[0]:
            yield rows


def _confirmed(node: np.ndarray, part: np.ndarray, grams: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges between nodes of one task whose sets have a Jaccard similarity of ``least`` or more; a spanning forest of them.

    Sets are taken by size; pairs whose sizes differ too much, or that are connected already, are passed over.
    """
    size = np.array([len(g) for g in grams])
    order = np.argsort(size, kind="stable")
    size, node, part = size[order], node[order], part[order]
    grams = [grams[k] for k in order]
    across = len(np.unique(part)) > 1
    _, root = np.unique(node, return_inverse=True)  # rows of one node are connected from the start
    edges = []
    for i in range(len(node)):
        stop = int(np.searchsorted(size, size[i] / least + 1e-9, side="right"))
        for j in np.flatnonzero((root[i + 1 : stop] != root[i]) & ((part[i + 1 : stop] != part[i]) | (not across))) + i + 1:
            if root[j] == root[i]:
                continue  # connected since
            both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
            if both >= least * (size[i] + size[j] - both):
                root[root == root[j]] = root[i]
                edges.append((int(node[i]), int(node[j])))
    return edges


def confirmed(docs: DataFrame, members: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """Edges (u, v) of members (doc_id, component) of one component whose texts are alike by exact shingle sets.

    Similarity is Jaccard's on the sets of ``width``-word shingles (32 bits of their hashes). Components of over PART
    members are dealt to a task for each pair of parts; a task yields a forest, never all pairs.
    """
    size = members.groupBy("component").agg(F.count("*").alias("size"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = texts.join(members.join(size, "component"), "doc_id").select("doc_id", "text", "component", "size")
    dealt = map_rows(own, lambda b: _shingle_sets(b, width), "task long, node long, part int, grams binary")

    def compare(batches):
        held: list[tuple] = []

        def edges() -> list:
            if len(held) < 2:
                return []
            node, part = (np.array([r[k] for r in held], np.int64) for k in (1, 2))
            return _confirmed(node, part, [np.frombuffer(r[3], np.uint32) for r in held], least)

        found: list[tuple[int, int]] = []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and held[0][0] != row[0]:
                    found.extend(edges())
                    held = []
                held.append(row)
            if found:
                yield [list(x) for x in zip(*found, strict=True)]
                found = []
        if last := edges():
            yield [list(x) for x in zip(*last, strict=True)]

    return map_rows(dealt.repartition("task").sortWithinPartitions("task"), compare, "u long, v long").distinct()


def keep_first(docs: DataFrame, radius: int = 5, prints: int = 4, least: float = 0.8) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, all columns, of whatever names, as they were.

    Documents are candidates when any of ``prints`` fingerprints of their three-word shingles differ in ``radius`` bits
    at most (one fingerprint with a small radius misses most near copies that have a similarity of just over 0.8).
    Within the groups that candidates form, those link whose sets of five-word shingles have a Jaccard similarity of
    ``least`` or more; documents with all fingerprints equal are one. A text of fewer words is one shingle.
    Of rows that repeat a doc_id the one with the least hash of all its columns stays, so that the choice is the
    same whenever it is made. Rows without a doc_id stay, but one of those with equal texts. A null text has no
    words; an empty table gives no rows. Ids and hashes decide; the rows themselves are exchanged once, and once for the sets.
    """
    doc_id, row, names = F.col("doc_id").cast("long"), whole_row(docs), _names(prints)
    key = {"known": doc_id.isNotNull().cast("long"), "key": F.coalesce(doc_id, F.xxhash64(F.col("text"))), "hash": F.xxhash64(row)}
    found = cut(fingerprints(docs, prints=prints, **key))
    nodes, repeated = _nodes(found, names)
    members = cut(components(links(nodes, radius)).select(F.col("node").alias("doc_id"), "component"))
    first = _with_component(found, nodes, confirmed(docs, members, least).unionAll(repeated), names).where("doc_id = component_id or doc_id is null")
    kept = first.groupBy("known", "key").agg(F.min("hash").alias("hash"))
    rows = docs.select(row.alias("row"), *[c.alias(n) for n, c in key.items()])
    one = rows.join(kept, [*key]).dropDuplicates([*key])  # what is left of a key is rows that are equal throughout
    return one.select(*columns_of("row", docs.columns))

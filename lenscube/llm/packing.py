"""Packing by minimum bin slack.

A scan partition packs its own documents, so nothing is shuffled. Documents are cut into full windows
and one remainder. The remainders wait in a bounded buffer; each window takes the longest remainder and
a bitset subset-sum over the multiset of the other lengths finds the selection that fills it closest to
capacity. Backtracking gives how many of each length it takes, and the same selection is repeated while
the counts last. A window that stays short is topped up by cutting one more remainder. The last, partial
window of a partition is cut at powers of two, where no padding is due.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lenscube.llm.common import docs_of, map_rows, slices

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
WIDTH = 4  # bytes of an id
#: Words whose ids a Python worker remembers, at most.
REMEMBERED = 400_000
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids (little-endian bytes) by white-space free word; exact, since merges never cross white space.

    A word of Latin letters, with a full stop or comma at most, goes straight to the merges, which is
    what the normaliser and splitter would do with it; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters: dict[str, bytes] = {}
        self.byte_letters = _byte_letters()

    def whole(self, word: str) -> bytes:
        return b"".join(i.to_bytes(WIDTH, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)

    def run(self, letters: str) -> bytes:
        found = self.letters.get(letters)
        if found is None:
            if len(self.letters) >= REMEMBERED:
                self.letters.clear()
            shown = letters if letters.isascii() else "".join(map(self.byte_letters.__getitem__, letters.encode()))
            found = self.letters[letters] = b"".join([t.id.to_bytes(WIDTH, "little") for t in self.merge(shown)])
        return found

    def __missing__(self, word: str) -> bytes:
        if (m := _LETTERS.fullmatch(word)) and len(word) < 100:
            ids = self.run(m[1].lower()) + (self.run(m[2]) if m[2] else b"")
        else:
            ids = self.whole(word)
        if len(word) < 100:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_word_ids: dict[str, WordIds] = {}


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian 32-bit integers; kept for the worker's next tasks."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path].encode


def fill(counts: list[tuple[int, int]], target: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``target`` of lengths with multiplicities, and how many of each it takes."""
    mask = (1 << (target + 1)) - 1
    bits, steps = 1, []
    for length, count in counts:
        part = 1
        while count and not bits >> target & 1:
            part = min(part, count)
            if length * part <= target:
                steps.append((bits, length, part))
                bits = (bits | bits << (length * part)) & mask
            count -= part
            part *= 2
        if bits >> target & 1:
            break
    best = total = bits.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for before, length, part in reversed(steps):
        if not before >> total & 1:
            taken[length] += part
            total -= length * part
    return best, dict(taken)


class Packer:
    """Windows from remainders; an item is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length = capacity, defaultdict(list)

    def __len__(self) -> int:
        return sum(map(len, self.by_length.values()))

    def add(self, item: tuple) -> None:
        self.by_length[len(item[3]) // WIDTH].append(item)

    def take(self, length: int) -> tuple:
        item = self.by_length[length].pop()
        if not self.by_length[length]:
            del self.by_length[length]
        return item

    def windows(self, keep: int) -> Iterator[list[tuple]]:
        """Windows until ``keep`` items are left at most; the last window of all may be short."""
        left = len(self)
        while left > keep:
            longest = max(self.by_length)
            counts = [(n, len(x) - (n == longest)) for n, x in sorted(self.by_length.items(), reverse=True)]
            best, taken = fill(counts, self.capacity - longest)
            taken[longest] = taken.get(longest, 0) + 1
            times = min(len(self.by_length[n]) // k for n, k in taken.items())
            slack = self.capacity - longest - best
            for _ in range(times if not slack else 1):
                window = [self.take(n) for n, k in taken.items() for _ in range(k)]
                left -= len(window)
                if slack and left and (larger := [n for n in self.by_length if n > slack]):
                    doc_id, start, total, ids = self.take(min(larger))
                    window.append((doc_id, start, total, ids[: slack * WIDTH]))
                    self.add((doc_id, start + slack, total, ids[slack * WIDTH :]))
                yield window


def _at_powers(window: list[tuple]) -> Iterator[list[tuple]]:
    """A short window cut into ones whose lengths are powers of two."""
    total = sum(len(x[3]) for x in window) // WIDTH
    rest = list(window)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        part: list[tuple] = []
        while size:
            doc_id, start, n, ids = rest.pop(0)
            if len(ids) // WIDTH > size:
                rest.insert(0, (doc_id, start + size, n, ids[size * WIDTH :]))
                ids = ids[: size * WIDTH]
            part.append((doc_id, start, n, ids))
            size -= len(ids) // WIDTH
        yield part


def pack_stream(docs: Iterable[tuple], encode: Callable[[str], bytes], capacity: int, end: int, buffered: int) -> Iterator[list[tuple]]:
    """Windows (lists of pieces) from (doc_id, text); at most ``buffered`` remainders and one document are held."""
    packer, tail = Packer(capacity), end.to_bytes(WIDTH, "little")
    for doc_id, text in docs:
        ids = (encode(text) if text else b"") + tail
        total, step = len(ids) // WIDTH, capacity * WIDTH
        full = len(ids) // step
        for k in range(full):
            yield [(doc_id, k * capacity, total, ids[k * step : (k + 1) * step])]
        if len(ids) > full * step:
            packer.add((doc_id, full * capacity, total, ids[full * step :]))
        if len(packer) >= buffered:
            yield from packer.windows(buffered // 4)
    for window in packer.windows(0):
        if sum(len(x[3]) for x in window) == capacity * WIDTH:
            yield window
        else:
            yield from _at_powers(window)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end: int = 2, buffered: int = 2048) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers. A null or empty text is the
    one id ``end``. Rows that repeat a doc_id are packed each by itself; a null doc_id stays null. An empty
    table gives no rows. Sequence ids are unique: the partition's number in the high bits, a running number
    in the low ones.
    """

    def run(batches):
        encode = encoder(tokenizer_path)
        base, number, rows = TaskContext.get().partitionId() << 32, 0, []
        texts = ((d, t) for b in slices(batches, 1 << 22) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        held = 0
        for window in pack_stream(texts, encode, capacity, end, buffered):
            offset = 0
            for doc_id, start, total, ids in window:
                rows.append((doc_id, start, len(ids) // WIDTH, total, base + number, offset, ids))
                offset += len(ids) // WIDTH
            number += 1
            held += offset
            if held > 1 << 20:
                yield [list(c) for c in zip(*rows, strict=True)]
                rows, held = [], 0
        if rows:
            yield [list(c) for c in zip(*rows, strict=True)]

    return map_rows(docs_of(docs), run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


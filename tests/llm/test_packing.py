import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lenscube.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", ["Ça va, l'été ÉCOLE!! don't", "á b́\ńc", "x" * 300 + " <|endoftext|> y", "tab\tnbsp  z", "ΣΑΣ ΑΣ.", "3.14 e=mc² ß ÿ Ÿ İ"])
def test_word_ids_equal_whole_text(text):
    got = packing.encoder(PATH)(text)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == ids_of(text)[:-1]


def test_fill_takes_what_brute_force_takes():
    import itertools
    import random

    r = random.Random(3)
    for _ in range(200):
        counts = [(n, r.randint(1, 3)) for n in sorted(r.sample(range(1, 40), 5), reverse=True)]
        target = r.randint(0, 90)
        best, taken = packing.fill(counts, target)
        sums = [sum(k * n for k, (n, _) in zip(ks, counts)) for ks in itertools.product(*[range(c + 1) for _, c in counts])]
        assert best == max(s for s in sums if s <= target) == sum(n * k for n, k in taken.items())
        assert all(k <= dict(counts)[n] for n, k in taken.items())


def test_pack_is_a_partition_of_the_tokens(spark):
    texts = ["one two three", None, "", "x " * 9000, "A b. c", "A b. c", *(f"word{i} " * (i % 50 + 1) for i in range(300))]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(2)
    out = packing.digest(packing.pack(docs, PATH, capacity=512)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = ids_of(t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 512 or at & (at - 1) == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []

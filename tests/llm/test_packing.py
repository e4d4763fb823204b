import bisect
import random
import zlib

import numpy as np
import pytest

from loomcorpus.llm import packing
from loomcorpus.llm.queries import tokenizer_path
from loomcorpus.llm.shared import Scratch

TEXTS = [None, "", "   ", "Hello, World! it's 3.14", "Éèç ß übung STRASSE", "İstanbul ΑΣ ὈΔΥΣΣΕΎΣ", "a\x1cb\x85c\xa0d", "<|endoftext|> x <|ENDOFTEXT|>", "日本語 テスト mixed words.", "é combining", "foo...bar,, 12a ´` x" * 3, "word " * 9000, "don't we'll 'tis ª º µ"]


def test_encoder_equals_tokenizer():
    enc = packing.WordEncoder(tokenizer_path(), limit=50)
    rng = random.Random(1)
    alphabet = "abcXYZéÈß.,;'!? \t\n\x0b09µª-_<|>\x85\xa0"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t, raw in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_get_whole_texts():
    enc = packing.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert not enc.by_word and packing.WordEncoder(tokenizer_path()).by_word
    for t, raw in zip([t or "" for t in TEXTS], enc.encode([t or "" for t in TEXTS]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_equal_rows_are_dealt_apart(spark):
    docs = spark.createDataFrame([(None, "")] * 4000, "doc_id long, text string")
    out = packing.packed(docs, tokenizer_path(), Scratch(spark, "t"), shard=1000)
    assert out.count() == 4000 and out.select("sequence_id").distinct().count() >= 1
    pieces = packing.token_pieces(docs.repartition(3), tokenizer_path())
    assert pieces.select("salt").distinct().count() == 4000


def best_fit(lengths, capacity=4096):
    """Bins that best fit from the longest opens."""
    room = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, n)
        r = room.pop(at) - n if at < len(room) else capacity - n
        bisect.insort(room, r)
    return len(room)


@pytest.mark.parametrize("kinds", [[2112, 1088, 1152, 896, 896], [1640, 1420, 1300, 1036, 1000]])
def test_local_search_beats_best_fit(kinds):
    rng = random.Random(4)
    lengths = [n for n in kinds for _ in range(120)]
    rng.shuffle(lengths)
    bins = packing.pack(lengths)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert len(bins) < best_fit(lengths)


@pytest.mark.parametrize("seed", range(6))
def test_local_search_reaches_the_bound(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 4097), rng.randrange(1, 600)]) for _ in range(800)]
    bins = packing.pack(lengths)
    assert sorted(i for b in bins for i in b) == list(range(800))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 4096) + 1


def test_local_search_empties_a_bin():
    # best fit from the longest needs three bins of ten here; an exchange makes it two
    lengths = [6, 5, 3, 2, 2, 2]
    bins = packing.pack(lengths, capacity=10)
    assert len(bins) == 2


def test_packed_table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as shard", "3 as piece")
    out = packing.packed(docs, tokenizer_path(), Scratch(spark, "t"), shard=8).collect()
    tok = packing.WordEncoder(tokenizer_path()).tokenizer
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((-1 if i is None else i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in out) // 4096) + 3
    assert packing.packed(docs.limit(0), tokenizer_path(), Scratch(spark, "t")).count() == 0


def test_local_search_of_a_large_shard():
    # best fit from the longest opens over a thousand bins more than the 6,000 that are enough
    lengths = [2112, 1088, 1152] * 4000 + [896] * 8000
    random.Random(2).shuffle(lengths)
    bins = packing.pack(lengths)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 4096) + 10

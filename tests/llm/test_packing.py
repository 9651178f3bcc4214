import bisect
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from strataglyph.llm import packing
from strataglyph.llm.packing import VOCABULARY, brackets, carried, pack
from strataglyph.llm.tokens import encoder, vocabulary

from ..conftest import SMALL

DOCS = "doc_id long, text string, sequence_id string, length int"


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for size in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, size)
        n += i == len(gaps)
        gap = capacity if i == len(gaps) else gaps.pop(i)
        if gap > size:
            bisect.insort(gaps, gap - size)
    return n


def test_brackets():
    r = random.Random(4)
    for n in (0, 1, 2, 50):
        for _ in range(30):
            gap = np.array([r.random() < 0.5 for _ in range(n)], bool)
            open_, want = [], []
            for i, g in enumerate(gap):
                if not g:
                    open_.append(i)
                elif open_:
                    want.append((open_.pop(), i))
            assert sorted(zip(*(x.tolist() for x in brackets(gap)), strict=True)) == sorted(want)


def test_ranges_give_the_matching_of_the_whole():
    r = random.Random(5)
    for _ in range(50):
        gap = np.array([r.random() < 0.5 for _ in range(60)], bool)
        cuts = [0, *sorted(r.sample(range(61), 4)), 60]
        got, left, counts = set(), {}, []
        for part, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            a, b = brackets(gap[lo:hi])
            got |= set(zip((a + lo).tolist(), (b + lo).tolist(), strict=True))
            rest = [i for i in range(lo, hi) if i not in {x for p in got for x in p}]
            left[part] = [i for i in rest if not gap[i]], [i for i in rest if gap[i]]
            counts.append((part, *map(len, left[part])))
        for part, lo, hi, at, used in carried(counts):
            got |= {(left[part][0][i], left[at][1][used + hi - 1 - i]) for i in range(lo, hi)}
        assert got == set(zip(*(x.tolist() for x in brackets(gap)), strict=True))


def test_as_few_sequences_as_sequential_best_fit(spark, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(packing, "RANGE_ROWS", 40)  # many ranges, and pieces that are numbered part by part
    for tail, capacity, sizes in ((5, 64, lambda: r.randint(1, 64) if r.random() < 0.7 else 22), (0, 7, lambda: r.randint(1, 5)), (40, 64, lambda: r.randint(1, 40)), (5, 1, lambda: 1)):
        monkeypatch.setattr(packing, "TAIL", tail)
        lengths = [sizes() for _ in range(300)]
        cut = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
        monkeypatch.setattr(packing, "pieces", lambda *_: spark.createDataFrame(cut, packing._PIECES).repartition(3))  # noqa: B023
        got = packing.pack(spark.createDataFrame([], DOCS), capacity).collect()
        assert sorted((x.doc_id, x.length) for x in got) == list(enumerate(lengths))
        used = Counter()
        for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
            assert used[x.sequence_id] == x.offset
            used[x.sequence_id] += x.length
        assert max(used.values()) <= capacity
        assert len(used) <= best_fit(lengths, capacity) + 1
        assert len({x[2] for x in packing.sequential(list(enumerate(lengths)), [], capacity)}) == best_fit(lengths, capacity)


def test_query_needs_no_more_sequences_than_sequential_best_fit(spark):
    got = packing.op6_best_fit_packing(spark, SMALL).select("sequence_id", "length").collect()
    assert len({x.sequence_id for x in got}) == best_fit([x.length for x in got], packing.CAPACITY)


def test_pack(spark):
    rows = [(1, "a b c", "x", 1), (2, None, None, None), (3, "", "y", 2), (None, "hello world", "z", 3), (5, "word " * 700, "q", 4), (5, "word " * 700, "q", 4)]
    got = pack(spark.createDataFrame(rows, DOCS), capacity=256).collect()
    encode = encoder(vocabulary(VOCABULARY))
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = encode(text) + bytes(4)
        for k in range(0, len(ids), 1024):
            want[(doc_id, k // 1024, k // 4, len(ids[k : k + 1024]) // 4, zlib.crc32(ids[k : k + 1024]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 256
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def test_ids_equal_the_library():
    path = vocabulary(VOCABULARY)
    whole, fast = Tokenizer.from_file(path), encoder(path)
    r = random.Random(2)
    pool = "abcXYZéÀñ'st'll 12 \t\n\xa0\x85\x0b\x0c\x1c ​é́İΣς&*$<|>²½ªµ\x00\x7f你好﻿ "
    for k in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 30))) + ("<|endoftext|> a" if k % 50 == 0 else "")
        assert np.frombuffer(fast(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids

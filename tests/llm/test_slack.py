import random
from collections import Counter
from itertools import product

import numpy as np
from tokenizers import Tokenizer

from strataglyph.llm import slack
from strataglyph.llm.slack import Plan, closest, pack
from strataglyph.llm.tokens import byte_encoder, vocabulary

from ..conftest import SMALL

DOCS = "doc_id long, text string, sequence_id string, length int"


def test_closest_sum_against_every_multiset():
    r = random.Random(1)
    for _ in range(300):
        items = [(k, n, r.randint(1, 4)) for k, n in enumerate(r.sample(range(1, 30), r.randint(1, 4)))]
        target = r.randint(1, 80)
        best, taken = closest(items, target)
        sums = {s for c in product(*(range(n + 1) for _, _, n in items)) if (s := sum(x * y[1] for x, y in zip(c, items, strict=True))) <= target}
        assert best == max(sums) == sum(taken.get(k, 0) * n for k, n, _ in items)
        assert all(taken.get(k, 0) <= n for k, _, n in items)


def placed(plan, counts):
    """Every part: (sequence, offset, length), by walking the plan piece by piece."""
    keys, rows = plan.arrays()
    for length, n in counts.items():
        for number in range(n):
            kind, at = length, number
            while kind >= 0:
                row = rows[np.searchsorted(keys, (kind << slack.NUMBERS) + at, "right") - 1]
                k = at - row[1]
                yield int(row[3] + k // row[2]), int(row[4] + k % row[2] * row[5]), int(row[5])
                kind, at = int(row[6]), k


def test_plans_fill_every_window():
    r = random.Random(2)
    for k in range(200):
        capacity = r.choice((1, 7, 16, 64))
        lengths = [r.randint(1, capacity) if k % 3 else capacity * 2 // 3 + 1 if capacity > 3 else 1 for _ in range(r.randint(0, 300))]
        counts = Counter(lengths)
        plan = Plan.of(dict(counts), capacity)
        got = sorted(placed(plan, counts))
        fill = Counter()
        for seq, off, n in got:
            assert fill[seq] == off
            fill[seq] += n
        full, rest = divmod(sum(lengths), capacity)
        assert sorted(fill.values()) == sorted([capacity] * full + [1 << b for b in range(rest.bit_length()) if rest >> b & 1])
        assert sorted(fill) == list(range(plan.sequences))


def test_plan_of_very_many_pieces_is_small():
    r = random.Random(3)
    counts = {n: r.randint(1, 10**10) for n in range(1, 2049)}
    plan = Plan.of(counts, 2048)
    assert len(plan.rows) < 60_000
    assert 0 <= plan.sequences - sum(n * c for n, c in counts.items()) // 2048 < 12


def checked(docs, got, capacity):
    lib = Tokenizer.from_file(vocabulary(slack.VOCABULARY))
    import zlib

    ids = {k: [*(lib.encode(t or "", add_special_tokens=False).ids), 1] for k, t in docs}
    parts, fill = {}, Counter()
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert fill[x.sequence_id] == x.offset
        fill[x.sequence_id] += x.length
        own = ids[x.doc_id]
        assert x.doc_tokens == len(own)
        assert zlib.crc32(np.array(own[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32
        parts.setdefault(x.doc_id, []).append((x.start, x.length))
    assert max(fill.values(), default=0) <= capacity
    assert all(n == capacity or n & (n - 1) == 0 for n in fill.values())
    return ids, parts


def test_round_trip(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(("alpha", "bêta", "gamma,", "ß", "\n")) for _ in range(r.choice((3, 30, 300))))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "word " * 3000), (103, "你好 <|endoftext|>\t x")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], DOCS).repartition(3)
    ids, parts = checked(docs, pack(df, capacity=256).collect(), 256)
    for k, own in ids.items():
        at = 0
        for start, n in sorted(parts[k]):
            assert start == at
            at += n
        assert at == len(own)


def test_lengths_that_never_fit_are_cut(spark, monkeypatch):
    for few in (0, 10**6):  # shuffled and broadcast
        monkeypatch.setattr(slack, "FEW_PARTS", few)
        docs = [(i, "a b c d e f g") for i in range(40)]
        checked(docs, pack(spark.createDataFrame([(k, t, "x", 1) for k, t in docs], DOCS), capacity=16).collect(), 16)


def test_repeats_nulls_and_none(spark):
    df = spark.createDataFrame([(None, "x", "a", 1), (5, "y", "a", 1), (5, "y", "a", 1)], DOCS)
    got = pack(df).collect()
    assert sum(x.length for x in got) == sum(len(byte_encoder(vocabulary(slack.VOCABULARY))(t)) // 2 + 1 for t in "xyy")
    assert Counter(x.doc_id for x in got if x.start == 0) == {None: 1, 5: 2}
    assert pack(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = slack.op11_minimum_slack_packing(spark, SMALL).collect()
    ids, parts = checked(docs, got, slack.CAPACITY)
    assert set(parts) == set(ids) and sum(x.length for x in got) == sum(map(len, ids.values()))


def test_ids_equal_the_library():
    path = vocabulary(slack.VOCABULARY)
    whole, fast = Tokenizer.from_file(path), byte_encoder(path)
    r = random.Random(2)
    for pool in ("abcXYZéÀñ'st'll 12 \t\n\xa0\x85\x0b\x0c\x1c ​é́İΣς&*$<|>²½ªµ\x00\x7f你好﻿  ", "abc'st \n.,é12"):
        for k in range(3000):
            text = "".join(r.choice(pool) for _ in range(r.randint(0, 30))) + ("<|endoftext|> a" if k % 50 == 0 else "")
            assert np.frombuffer(fast(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids

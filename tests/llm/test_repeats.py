import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from strataglyph.llm.repeats import CHUNK, SPAN, _dedup, _Prefixes, dedup, segments, suffix_order
from strataglyph.llm.workspace import Workspace


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + SPAN] for b in data for i in range(len(b) - SPAN + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - SPAN + 1):
            if seen[b[i : i + SPAN]] > 1:
                gone[i : i + SPAN] = b"\1" * SPAN
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    s = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    long, p, q, z, hot = s(700), s(450), s(380), s(1500), s(420)
    texts = [None, "", "x" * 399, "x" * 400, "y" * 900, long, long, s(30) + p + s(50), s(100) + p, p + s(20) + p, s(300) + q + s(99), q + s(300), z, z[:700] + "!" + z[701:], z[100:1200], z[:450] + s(5) + z[600:1010], "ab" * 400, s(200) + "ab" * 250]
    # more unlike neighbours than one bucket holds
    texts += [s(r.randint(0, 200)) + hot[: r.randint(395, 420)] + s(r.randint(0, 200)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert dedup(df.limit(0)).count() == 0
    assert dedup(df.limit(3), keep_text=True).columns[-1] == "kept"


def test_digests_that_collide_are_noticed(spark):
    r = random.Random(7)
    s = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    hot = [s(230) for _ in range(8)]  # segments of one anchor and one shape, but of other bytes around it
    texts = [s(350) + h + s(350) for h in hot for _ in range(4)] + [s(20) + hot[0] * 2 + s(9), s(7) + hot[0] * 2]

    def weak(data, seed):
        return xxhash.xxh3_128_digest(bytes(data), seed) if seed else len(data).to_bytes(16)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for digest in (xxhash.xxh3_128_digest, weak):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in dedup(df, digest=digest).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)
    space = Workspace(spark, "t")
    with pytest.raises(Exception, match="Collision"):
        _dedup(space, df, False, 0, weak).collect()


def test_a_text_longer_than_a_chunk(spark):
    r = random.Random(9)
    body = bytes(r.choice(b"0123456789abcdefghijklmnopqrstuv") for _ in range(CHUNK + 300_000)).decode()
    passage = body[CHUNK - 500 : CHUNK + 500]
    text = body[: CHUNK + 200_000] + passage + body[CHUNK + 200_000 :]
    other = "x" + body[1000:1500]
    df = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    got = {x.doc_id: x for x in dedup(df).collect()}
    left = text[:1000] + text[1500 : CHUNK - 500] + text[CHUNK + 500 : CHUNK + 200_000] + text[CHUNK + 201_000 :]
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (2500, 3, hashlib.sha256(left.encode()).hexdigest())
    assert (got[2].n_removed, got[2].n_spans) == (500, 1)


def test_segments_cover_every_start_once():
    r = random.Random(1)
    data = bytes(r.choice(b"abc") for _ in range(5000))
    _, _, _, first, last, anchor = segments(data)
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]).tolist() == list(range(len(data) - SPAN + 1))
    assert ((anchor >= last) & (anchor < first + 201)).all()
    assert len(segments(b"short")[0]) == 0


def test_suffix_sort():
    r = random.Random(2)
    data = bytes(r.choice(b"ab") for _ in range(600))
    start = np.arange(0, 400)
    bucket = start % 3
    end = np.minimum(start + 50, 600)
    order = suffix_order(bucket, start, end, _Prefixes(np.frombuffer(data, np.uint8)))
    key = lambda i: (bucket[i], data[start[i] : end[i]])
    assert [key(i) for i in order] == sorted(map(key, range(400)))

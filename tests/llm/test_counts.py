from strataglyph.llm import counts
from strataglyph.llm.counts import HEAD, SEPARATOR, VOCABULARY, named, op1_token_counts, scan, write_flat
from strataglyph.llm.tokens import encoder, vocabulary
from strataglyph.llm.workspace import Workspace

from ..conftest import SMALL


def test_round_trip_at_any_block_size(spark):
    rows = [(1, None, 0), (None, "a b <|endoftext|> c", 0), (-5, "", 0), ((1 << 62) + 3, "x", 0), (-(1 << 63), "y " * 200, 0), (1, "again", 0)]
    path = Workspace(spark, "t").path("flat")
    write_flat(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").coalesce(1), path)
    encode = encoder(vocabulary(VOCABULARY), 2, False)
    sizes = [len(encode(t)) // 2 for _, t, _ in rows]
    starts = [sum(sizes[:k]) + k * (HEAD + 1) for k in range(len(rows))]
    want = [(i, n, k, s) for k, ((i, _, _), n, s) in enumerate(zip(rows, sizes, starts, strict=True))]
    for block in (1, 2, 3, 7, 64, 1 << 17):
        got = named(scan(spark, path, block=block)).orderBy("ordinal").collect()
        assert [(r.doc_id, r.n_tokens, r.ordinal, r.start) for r in got] == want


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(counts, "FILE_BYTES", 100)
    rows = [(i, "a b c d e f g h " * (i % 5)) for i in range(40)] + [(99, "long " * 300_000), (99, "long " * 300_000)]
    path = Workspace(spark, "t").path("flat")
    write_flat(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert sorted(sizes)[-2:] == [2 * (HEAD + 300_000 + 1)] * 2 and sorted(sizes)[-3] <= 100
    got = sorted((r.doc_id, r.n_tokens) for r in named(scan(spark, path)).collect())
    assert got == sorted((i, len(t.split())) for i, t in rows)


def test_foreign_files(spark, tmp_path):
    end = SEPARATOR.to_bytes(2, "little")
    (tmp_path / "a.bin").write_bytes(b"\1\0" * 3 + end + end + b"\2\0")  # no separator at the end
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (1, 2, 100):
        got = scan(spark, f"file://{tmp_path}", block=block, head=0).orderBy("ordinal").collect()
        assert [(r.start, r.n_tokens) for r in got] == [(0, 3), (4, 0), (5, 1)]


def test_query_counts_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    encode = encoder(vocabulary(VOCABULARY), 2, False)
    got = {r.doc_id: r.n_tokens for r in op1_token_counts(spark, SMALL).collect()}
    assert got == {d.doc_id: len(encode(d.text)) // 2 for d in docs}
    path = Workspace(spark, "t").path("none")
    write_flat(spark.createDataFrame([], "doc_id long, text string"), path)
    assert scan(spark, path).count() == 0

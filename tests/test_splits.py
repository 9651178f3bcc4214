import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strataglyph.sources import raw, splits


@pytest.fixture
def small_splits(spark):
    """Splits of 2,000 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def morphology(n):
    r = random.Random(n)
    lines = []
    for k in range(n):
        lines += [""] * (r.random() < 0.1)
        lines.append(f"{k // 9 + 1}:{k % 9 + 1}:1:1\tص{'x' * r.randint(0, 40)}\tN\tROOT:{k}")
    return lines


@pytest.mark.parametrize("feed", ("\n", "\r\n"))
def test_lines_have_the_numbers_of_one_reader(spark, small_splits, tmp_path, feed):
    lines = morphology(600)
    (tmp_path / "m.tsv").write_bytes(feed.join([*lines, ""]).encode())
    rows = splits.records(spark, str(tmp_path / "m.tsv"))
    assert rows.rdd.getNumPartitions() > 5 and rows.select("block").distinct().count() > 5
    got = splits.lines(spark, str(tmp_path / "m.tsv"))
    assert [(r.line, r.value) for r in got.orderBy("line").collect()] == list(enumerate(lines))
    found = raw.morphology_file(spark, str(tmp_path / "m.tsv")).orderBy("line").collect()
    assert [(r.line, r.features) for r in found] == [(i, x.split("\t")[3]) for i, x in enumerate(lines) if x]
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan  # the one over splits has been written


def test_files_of_a_folder_as_one(spark, small_splits, tmp_path):
    lines = morphology(300)
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines[k * 100 : k * 100 + 100]) + "\n", "utf-8")
    got = splits.lines(spark, str(tmp_path), as_one=True)
    assert [(r.line, r.value) for r in got.orderBy("line").collect()] == list(enumerate(lines[:300]))
    # chunks go on over the ends of files
    leaves = splits.chunks(splits.numbered(splits.records(spark, str(tmp_path)), as_one=True), 70)
    assert [(r.chunk, r.digest) for r in leaves.orderBy("chunk").collect()] == list(enumerate(by_hand(lines[:300], 70, 9, 0)[0]))


@pytest.mark.parametrize("indent", (None, 1))
def test_elements_are_cut_at_braces_outside_strings(spark, small_splits, tmp_path, indent):
    r = random.Random(4)
    texts = ["".join(r.choice('{}"\\[],:ab ص\n') for _ in range(r.randint(0, 60))) for _ in range(400)]
    data = {"quran": [{"chapter": k // 7 + 1, "verse": k % 7 + 1, "text": t} for k, t in enumerate(texts)]}
    for name, top in (("one.json", data), ("none.json", {"quran": []})):
        (tmp_path / name).write_text(json.dumps(top, ensure_ascii=False, indent=indent), "utf-8")
    got = raw.edition_file(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(x.pos, x.surah, x.verse, x.raw) for x in got] == [(k, k // 7 + 1, k % 7 + 1, t) for k, t in enumerate(texts)]


def test_an_element_that_is_no_verse_fails(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"quran":[{"chapter":1,"verse":1,"words":"x"}]}')
    with pytest.raises(PySparkException, match="element 0"):
        raw.edition_file(spark, str(tmp_path / "e.json")).collect()


def by_hand(lines, size, fan, length):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = [sha("".join(map(sha, lines[k : k + size]))) for k in range(0, len(lines), size)]
    level = leaves
    while True:
        level = [sha("".join(level[k : k + fan])) for k in range(0, len(level), fan)]
        if len(level) == 1:
            return leaves, sha(f"{length}:{level[0]}")


def test_roots_and_chunks(spark, small_splits, tmp_path):
    lines = morphology(500)
    path = tmp_path / "m.tsv"
    path.write_text("\n".join(lines), "utf-8")
    leaves = splits.chunks(splits.numbered(splits.records(spark, str(path))), 10)
    want, root = by_hand(lines, 10, 4, 77)
    assert [r.digest for r in leaves.orderBy("chunk").collect()] == want
    sizes = leaves.select("file").distinct().withColumn("bytes", F.lit(77))
    assert splits.roots(leaves, sizes, 4).first().root == root


def test_a_changed_byte_is_told_with_its_chunk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splits.chunks, "__defaults__", (10,))
    lines = morphology(90)
    for key, text in (("a/m.tsv", "\n".join(lines)), ("a/e.json", '{"quran":[{"chapter":1,"verse":1,"text":"t"}]}')):
        (tmp_path / key).parent.mkdir(exist_ok=True)
        (tmp_path / key).write_text(text, "utf-8")
    where = str(tmp_path / "chunks")
    roots = raw.lock_chunks(spark, str(tmp_path), ["a/m.tsv", "a/e.json"], where)
    lock = {"files": {k: {"merkle": r} for k, r in roots.items()}}
    for key in roots:
        raw.verify(spark, str(tmp_path), key, lock, where)
    changed = [*lines]
    changed[33] = changed[33].replace("N\t", "V\t") if changed[33] else "x"
    (tmp_path / "a/m.tsv").write_text("\n".join(changed), "utf-8")
    with pytest.raises(raw.SourceError, match="chunk 3 changed$"):
        raw.verify(spark, str(tmp_path), "a/m.tsv", lock, where)
    (tmp_path / "a/m.tsv").write_text("\n".join(lines) + "\n", "utf-8")  # a last line feed
    with pytest.raises(raw.SourceError, match="its end"):
        raw.verify(spark, str(tmp_path), "a/m.tsv", lock, where)
    with pytest.raises(raw.SourceError, match="not in the lock"):
        raw.verify(spark, str(tmp_path), "a/none", lock)

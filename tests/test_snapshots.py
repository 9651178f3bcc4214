import pytest

from strataglyph.sources import shared, store

NAMES = ("surah", "lemma")


@pytest.fixture
def few(spark, monkeypatch):
    """A store of two tables."""
    monkeypatch.setattr(store, "TABLES", NAMES)
    monkeypatch.setattr(store, "SCHEMA", {})
    monkeypatch.setattr(store, "views", lambda t: {})
    return lambda n: {"surah": spark.range(n).toDF("number"), "lemma": spark.range(n, 2 * n).toDF("text")}


def made(spark, folder, tables):
    with store.version(spark, folder) as path:
        store.write(tables, path)
    return path


def numbers(spark, folder):
    return sorted(r.number for r in store.read(spark, folder)["surah"].collect())


def test_a_failed_build_leaves_the_last_store(spark, few, tmp_path):
    folder = f"file://{tmp_path}/s"
    made(spark, folder, few(3))
    for at in range(3):  # before, between and after the tables
        with pytest.raises(RuntimeError), store.version(spark, folder) as path:
            store.write(dict(list(few(9).items())[:at]), path)
            raise RuntimeError
        assert numbers(spark, folder) == [0, 1, 2] and len(store.versions(spark, folder)) == 1
    with pytest.raises(Exception, match="lemma"), store.version(spark, folder) as path:  # a table is missing as it is published
        store.write({"surah": few(9)["surah"]}, path)
    assert numbers(spark, folder) == [0, 1, 2] and store.damaged(spark, folder, deep=True) == []
    assert [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("_current.")] == []


def test_the_first_build_that_fails_leaves_nothing(spark, few, tmp_path):
    with pytest.raises(RuntimeError), store.version(spark, f"file://{tmp_path}/s") as path:
        store.write(few(2), path)
        raise RuntimeError
    assert not list((tmp_path / "s").glob("v-*"))


def test_readers_keep_their_version(spark, few, tmp_path):
    folder = f"file://{tmp_path}/s"
    made(spark, folder, few(2))
    old = store.read(spark, folder)["surah"]
    made(spark, folder, few(5))
    assert old.count() == 2 and numbers(spark, folder) == [0, 1, 2, 3, 4]
    third = made(spark, folder, few(1))
    assert len(store.versions(spark, folder)) == 3
    assert len(store.expire(spark, folder, keep=1)) == 2 and numbers(spark, folder) == [0]
    assert store.versions(spark, folder) == [third.rsplit("/", 1)[1]] == [store.current(spark, folder).rsplit("/", 1)[1]]


def test_an_old_version_can_be_published_again(spark, few, tmp_path):
    folder = f"file://{tmp_path}/s"
    first = made(spark, folder, few(2)).rsplit("/", 1)[1]
    made(spark, folder, few(5))
    store.publish(spark, folder, first)
    assert numbers(spark, folder) == [0, 1]
    assert len(store.expire(spark, folder, keep=1)) == 0  # the published one and the last one stay


def test_a_manifest_tells_what_is_damaged(spark, few, tmp_path):
    folder = f"file://{tmp_path}/s"
    path = made(spark, folder, few(4))
    assert store.damaged(spark, folder, deep=True) == []
    part = next(p for p in (tmp_path / "s" / path.rsplit("/", 1)[1] / "lemma").iterdir() if p.suffix == ".parquet")
    shared.delete(spark, f"file://{part}")
    assert store.damaged(spark, folder) == [f"lemma/{part.name}"]
    with pytest.raises(store.StoreError):
        store.damaged(spark, f"file://{tmp_path}/none")

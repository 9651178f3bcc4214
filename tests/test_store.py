import hashlib
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strataglyph import serve
from strataglyph.operators import checks, claims, digest, display, distance, export, search, variants
from strataglyph.operators.api import Api
from strataglyph.operators.sql import first_rows, read_only
from strataglyph.plans.build import BuildError, build, refuse_partial_editions
from strataglyph.plans.canon import EXPECTED
from strataglyph.sources import raw, store
from strataglyph.streaming.recheck import recheck

VERSES = {(1, 1): "بِسۡمِ ٱللَّهِ", (1, 2): "مَا قَالَ", (2, 1): "هُدࣰ ى لِلنَّاسِ", (2, 2): "تَجۡرِي نَبَتَ بَنَتۡ"}
#: The other edition: a vowel in 1:1, dots in 1:2, a word less in 2:2.
OTHER = {**VERSES, (1, 1): "بِسۡمُ ٱللَّهِ", (1, 2): "مَا فَالَ", (2, 2): "تَجۡرِي نَبَتَ"}
MORPHOLOGY = """1:1:1:1\tبِ\tP\tP|PREF|LEM:ب
1:1:1:2\tسْمِ\tN\tROOT:سمو|LEM:اسْم|M|GEN
1:1:2:1\tٱللَّهِ\tN\tPN|ROOT:أله|LEM:اللَّه|GEN

1:2:3:1\tمَا\tP\tREL|LEM:ما
1:2:4:1\tقَالَ\tV\tROOT:قول|LEM:قالَ|M|M
2:1:1:1\tهُدࣰى\tN\tROOT:هدي
2:1:2:1\tلِلنَّاسِ\tN\tROOT:نوس
2:2:1:1\tتَجۡرِي\tV\tROOT:جري
2:2:2:1\tنَبَتَ\tV\tROOT:نبت
"""


def edition(verses):
    return json.dumps({"quran": [{"chapter": s, "verse": v, "text": t} for (s, v), t in verses.items()]}, ensure_ascii=False)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("store")
    root = top / "raw"
    info = {"chapters": [{"chapter": s, "name": f"n{s}", "englishname": f"e{s}", "arabicname": f"a{s}", "revelation": r, "verses": [{"verse": v, "juz": 1, "manzil": 1, "page": 1, "ruku": 1, "maqra": 1, "sajda": False} for v in (1, 2)]} for s, r in ((1, "Mecca"), (2, "Madina"))]}
    files = {"a/info.json": json.dumps(info), "a/one.json": edition(VERSES), "a/two.json": edition(OTHER), "m/morph.tsv": MORPHOLOGY}
    lock = {"generated_at": "x", "files": {}}
    for key, text in files.items():
        path = root / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, "utf-8")
        lock["files"][key] = {"source": key[0], "repo": "r", "commit": "c", "path": key, "url": "u", "sha256": hashlib.sha256(text.encode()).hexdigest(), "bytes": len(text.encode()), "license": None}
    (top / "lock.json").write_text(json.dumps(lock), "utf-8")
    plan = {"info": "a/info.json", "morphology": "m/morph.tsv", "editions": [{"key": "a/one.json", "slug": "uthmani-hafs", "riwayah": "hafs", "orthography": "uthmani", "is_reference": True}, {"key": "a/two.json", "slug": "uthmani-warsh", "riwayah": "warsh", "orthography": "uthmani"}], "expect": {"surahs": 2, "ayahs": 4, "words": 8, "segments": 9, "exceptions": 1, "aligned_percent": 70, "verses": [2, 2]}}
    tables = build(spark, str(root), str(top / "lock.json"), plan, str(top / "out"))
    return top, root, lock, tables, plan


def test_spine(made):
    t = made[3]
    assert [(r.number, r.ayah_count, r.ayah_start, r.ayah_end, r.revelation_place) for r in t["surah"].orderBy("number").collect()] == [(1, 2, 1, 2, "meccan"), (2, 2, 3, 4, "medinan")]
    texts = t["ayah_text"].filter("edition_id = 1").orderBy("ayah_id").collect()
    joined = "\n".join(r.plain for r in texts)
    assert all(joined[r.char_start : r.char_end] == r.plain for r in texts)


def test_words(made):
    t = made[3]
    words = t["word"].orderBy("id").collect()
    assert [w.id for w in words] == list(range(1, 9))
    assert (words[0].root, words[0].lemma, words[0].segment_count) == ("سمو", "اسْم", 2)
    assert words[2].root is None
    segments = t["segment"].orderBy("id").collect()
    assert (segments[0].tag, segments[1].tag) == ("P", None)
    last = [s.id for s in segments if s.root == "قول"][0]
    assert t["segment_feature"].filter(F.col("segment_id") == last).filter("key = 'M'").count() == 1


def test_alignment(made):
    t = made[3]
    odd = t["spine_exception"].collect()
    assert [(r.ayah_id, r.text_tokens, r.corpus_words) for r in odd] == [(4, 3, 2)]
    assert len(odd[0].detail.text) == 3
    doc = "\n".join(r.plain for r in t["ayah_text"].filter("edition_id = 1").orderBy("ayah_id").collect())
    for r in t["word_text"].collect():
        assert doc[r.char_start : r.char_end] == r.form
    assert t["word_text"].count() == 6


def test_variants(made):
    rows = made[3]["variant"].orderBy("id").collect()
    assert [(r.ayah_id, r.op, r.ref_position, r.same_rasm, r.same_archi) for r in rows] == [(1, "replace", 1, 1, 1), (2, "replace", 2, 0, 1), (4, "delete", 3, 0, 0)]


def test_vanishing_tokens_keep_positions(spark):
    row = ([(1, 2, ["ء", "ب", "ت"], ["", "ب", "ت"], ["ب", "تَ"], ["ب", "ت"])], "ayah_id long, edition_id long, ref_plain array<string>, ref_rasm array<string>, var_plain array<string>, var_rasm array<string>")
    got = variants.differences(spark.createDataFrame(*row)).collect()
    assert [(r.ref_position, r.ref_text, r.var_text) for r in got] == [(3, "ت", "تَ")]


def test_api(made):
    api = Api(made[3])
    assert len(api.ladder("Q1:1-2")["ayahs"]) == 2
    assert len(api.ladder("Q1-2")["ayahs"]) == 4
    assert [w["segment_count"] for w in api.words(1)["words"]] == [2, 1]
    assert len(api.words(1)["words"][0]["segments"]) == 2
    got = api.apparatus(2)
    assert (len(got["consonantal"]), len(got["vocalic"]), got["orthographic_vocalic_count"]) == (1, 0, 0)
    assert api.skeleton("تجري")["skeleton"] == "ٮحرى"
    assert api.skeleton("تجري")["readings"][0]["examples"]
    assert api.search("الله", "rasm")["total"] == 1
    assert api.search("لله", "rasm")["total"] == 0
    assert api.search("الله", "raw")["total"] == 0
    assert api.ambiguous(-1)["clusters"] == []
    assert api.root("سمو")["root"]["word_count"] == 1
    assert api.roots("سم")["roots"]
    assert api.tree()["nearest"]["uthmani-hafs"] == {"slug": "uthmani-warsh", "distance": 2}
    assert "error" in api.call("ladder", {"ref": "Q9:1"})
    assert all(callable(getattr(api, r)) for r in Api.ROUTES)
    json.dumps(api.meta(), default=str)
    assert api.stats()["word"] == 8
    assert len(api.variants("Q1-2")) == 2
    assert len(api.variants("Q1-2", every=True)) == 3
    assert len(api.show("Q1:1", ["uthmani-hafs", "uthmani-warsh"], "plain")) == 2


def test_checks_hold_and_fail(spark, made):
    t = made[3]
    wanted = {"surahs": 2, "ayahs": 4, "words": 8, "segments": 9, "exceptions": 1, "aligned_percent": 70}
    rows = checks.all_checks(t, wanted, [2, 2], ["uthmani-hafs"]).collect()
    assert [r.name for r in rows if not r.ok] == []
    bad = dict(t)
    bad["word"] = t["word"].filter("id <> 3")
    bad["ayah_text"] = t["ayah_text"].withColumn("plain", F.concat("plain", F.lit("‏")))
    failed = {r.name for r in checks.all_checks(bad, wanted, [2, 3], ["uthmani-hafs", "no-such"]).collect() if not r.ok}
    assert {"number of words", "verse counts by surah", "declared editions are there", "no invisible characters at plain", "stored rungs equal their recomputation", "segment.word_id leads to word.id"} <= failed


def test_digest_ignores_order(made):
    t = {"word": made[3]["word"], "surah": made[3]["surah"]}
    again = {"surah": t["surah"].orderBy(F.desc("number")), "word": t["word"].repartition(3)}
    assert digest.content_digest(t) == digest.content_digest(again)
    assert digest.content_digest(t) != digest.content_digest({**t, "word": t["word"].limit(3)})


def test_claims(spark, made, tmp_path):
    (tmp_path / "1.toml").write_text('[claim]\nid = "a"\nstatement = "s"\nquery = "SELECT COUNT(*) FROM word"\nexpect = 8\n')
    (tmp_path / "2.toml").write_text('[claim]\nid = "b"\nstatement = "s"\nquery = "SELECT broken"\nexpect = 8\n')
    got = claims.run(spark, claims.load(str(tmp_path)))
    assert [r.ok for r in got] == [True, False]
    assert got[1].error
    with pytest.raises(claims.ClaimError):
        claims.from_dicts([{"id": "x"}])
    with pytest.raises(claims.ClaimError):
        claims.from_dicts([{"id": "x", "statement": "", "query": "", "expect": 1}] * 2)
    assert claims.shaped([]) == [] and claims.shaped([(1,), (2,)]) == [1, 2] and claims.shaped([(1, 2), (3, 4)]) == [[1, 2], [3, 4]]


def test_only_queries(spark, made):
    assert read_only(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a").first()[0] == 1
    assert read_only(spark, "SELECT ref FROM v_word WHERE id = 3").first()[0] == "Q1:2:1"
    for bad in ("DROP VIEW word", "CREATE TABLE x AS SELECT 1", "INSERT INTO word SELECT * FROM word", "SET a=b"):
        with pytest.raises(ValueError, match="only queries"):
            read_only(spark, bad)
    assert first_rows(spark.range(5).toDF("i"), 3)[1]


def test_export(made, tmp_path):
    sizes = export.export(made[3], str(tmp_path))
    assert set(sizes) == {"meta", "ayahs", "variants", "skeletons", "roots", "words"}
    read = {n: json.loads((tmp_path / f"{n}.json").read_text("utf-8")) for n in sizes}
    assert len(read["words"]) == 8 and len(read["ayahs"]) == 4
    assert [r["ayah_id"] for r in read["variants"]["rows"]] == [2, 4] and read["variants"]["vocalic"] == [{"ayah_id": 1, "vocalic": 1}]
    assert sizes == {n: (tmp_path / f"{n}.json").stat().st_size for n in sizes}
    assert export.totals({"a": 1, "b": 5, "c": 3}, 2) == (9, [("b", 5), ("c", 3)])


def test_incomplete_sources_are_refused(spark, made):
    top, root, _, _, plan = made
    for wrong, said in (({"surahs": 3}, "2 chapters, expected 3"), ({"verses": [2, 3]}, "chapter 2: 2 verses, expected 3"), (EXPECTED, "2 chapters, expected 114")):
        with pytest.raises(BuildError, match=said):
            build(spark, str(root), str(top / "lock.json"), {**plan, "expect": wrong}, str(top / "refused"))
    short = made[3]["ayah_text"].filter("edition_id = 1 or ayah_id > 1")
    with pytest.raises(BuildError, match="uthmani-warsh: 3 ayahs, expected 4"):
        refuse_partial_editions(short, made[3]["edition"], 4)
    assert sum(EXPECTED["verses"]) == EXPECTED["ayahs"] and len(EXPECTED["verses"]) == EXPECTED["surahs"]


def test_tables_have_what_they_declare(made):
    for name in store.TABLES:
        assert made[3][name].schema == store.declared(made[3][name], name).schema
    with pytest.raises(ValueError, match="root lacks letters"):
        store.declared(made[3]["root"].drop("letters"), "root")


def test_search_index(made):
    t = made[3]
    for level in search.SEARCHED:
        for phrase in ("الله", "قال", "ما قال", "بسم الله", "جري"):
            direct = {(r.edition_id, r.ayah_id) for r in search.phrase(t["ayah_text"], phrase, level).collect()}
            assert {(r.edition_id, r.ayah_id) for r in search.indexed(t, phrase, level).collect()} == direct
    assert search.indexed(t, "الله", "plain").count() == 0


def test_counters(made):
    assert [(r["slug"], r["ayahs"], r["consonantal"], r["vocalic"]) for r in Api(made[3]).counters()] == [("uthmani-hafs", 4, 0, 0), ("uthmani-warsh", 4, 2, 1)]


def test_fetch(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    (up / "x.json").write_text("1")
    row = lambda url: spark.createDataFrame([("a/x.json", "a", "github-raw", "r", "c", "x.json", None, url, "a/x.json")], "key string, source string, kind string, repo string, commit string, path string, license string, url string, local string")
    declared, root, lock = row((up / "x.json").as_uri()), str(tmp_path / "raw"), str(tmp_path / "lock.json")
    first = raw.fetch(spark, declared, root, lock)
    assert raw.fetch(spark, declared, root, lock) == first and first["files"]["a/x.json"]["bytes"] == 1
    (up / "x.json").write_text("22")
    assert raw.fetch(spark, declared, root, lock) == first  # it is there already
    with pytest.raises(raw.SourceError, match="not what was locked"):
        raw.fetch(spark, declared, root, lock, force=True)
    assert raw.fetch(spark, declared, root, lock, relock=True)["files"]["a/x.json"]["bytes"] == 2
    with pytest.raises(raw.SourceError, match="gone"):
        raw.fetch(spark, row((up / "gone.json").as_uri()), str(tmp_path / "none"), lock)
    assert not list((tmp_path / "none").rglob("*.part"))


def test_server(made):
    front = serve.server(Api(made[3]), 0)
    threading.Thread(target=front.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{front.server_port}{path}").read().decode()
    try:
        assert "/api/ladder" in get("/")
        assert len(json.loads(get("/api/ladder?ref=Q1"))["ayahs"]) == 2
        assert "error" in json.loads(get("/api/ladder?ref=Q9:1"))
        with pytest.raises(urllib.error.HTTPError):
            get("/api/stats")
    finally:
        front.shutdown()
        front.server_close()


def test_display(spark):
    df = spark.createDataFrame([("كِتَابٌۖ x", "Q2:3:4"), (None, None), ("", "Q1")], "t string, ref string")
    rows = df.select(display.tinted(F.col("t")).alias("runs"), display.ayah_of(F.col("ref")).alias("a")).collect()
    assert "".join(r.text for r in rows[0].runs) == "كِتَابٌۖ x" and [r["class"] for r in rows[0].runs] == [None, "vowel", None, "vowel", None, "vowel", "apparatus", None]
    assert [r.a for r in rows] == ["Q2:3", None, "Q1"] and rows[1].runs is None and rows[2].runs == []


def test_distances(spark):
    texts = {"a": "xyz", "b": "xyw", "c": "qyw"}
    df = spark.createDataFrame([(e, i, ch) for e, t in texts.items() for i, ch in enumerate(t)] + [("d", 7, "x")], "edition string, unit int, rasm string")
    got = {(r.a, r.b): (r.distance, r.intensity) for r in distance.intensity(distance.matrix(df)).collect()}
    want = {(a, b): sum(x != y for x, y in zip(texts[a], texts[b], strict=True)) for a in texts for b in texts}
    assert got == {k: (n, 1 - n / 2) for k, n in want.items()} | {("d", "d"): (0, 1.0)}


def test_verified_reads(spark, made):
    top, root, lock, _, plan = made
    with pytest.raises(raw.SourceError):
        raw.content(spark, str(root), "a/none.json", lock)
    wrong = {"files": {**lock["files"], "a/one.json": {**lock["files"]["a/one.json"], "sha256": "0"}}}
    with pytest.raises(PySparkException):
        raw.text_of(raw.content(spark, str(root), "a/one.json", wrong)).collect()
    found = {r.local: r.sha256 for r in raw.digests(spark, str(root)).collect()}
    assert found["a/one.json"] == lock["files"]["a/one.json"]["sha256"]


def test_declarations_and_lock(spark, made, tmp_path):
    (tmp_path / "s.toml").write_text('[[source]]\nid = "a"\nkind = "github-raw"\nrepo = "r"\ncommit = "c"\nfiles = ["info.json", "gone.json", "one.json"]\n')
    declared = raw.declarations(spark, str(tmp_path / "s.toml"))
    found = raw.digests(spark, str(made[1]))
    lock = spark.createDataFrame([("a/info.json", "changed"), ("a/one.json", made[2]["files"]["a/one.json"]["sha256"]), ("z/old", "1")], "key string, sha256 string")
    assert {(r.key, r.problem) for r in raw.compare(declared, found, lock).collect()} == {("a/info.json", "changed"), ("a/gone.json", "missing"), ("z/old", "undeclared")}
    first = raw.write_lock(declared, found, str(tmp_path / "lock.json"))
    assert raw.write_lock(declared, found, str(tmp_path / "lock.json")) == first


def test_bad_morphology(spark):
    rows = spark.createDataFrame([("1:1:1\tx\tN\tF",)], "text string")
    with pytest.raises(PySparkException):
        raw.morphology(rows).collect()


def test_search_postings_agree(spark):
    df = spark.createDataFrame([(1, "Café au lait"), (2, "lait au cafe"), (3, "au, lait!"), (4, "")], "k int, rasm string")
    for phrase in ("au lait", "cafe", "Café", "it", ""):
        direct = {r.k for r in search.phrase(df, phrase).collect()}
        index = search.postings(df, "k", "rasm")
        assert {r.k for r in search.phrase_by_postings(index, search.needle_terms(phrase, "rasm"), "k").collect()} == direct
    assert {r.k for r in search.phrase(df, "au lait").collect()} == {1, 3}


def test_recheck_stream(spark, tmp_path):
    data = tmp_path / "in"
    spark.range(3).toDF("id").write.parquet(str(data))
    told = []
    stream = spark.readStream.schema("id long").parquet(str(data))
    ledger = claims.from_dicts([{"id": "n", "statement": "", "query": "SELECT COUNT(*) FROM streamed", "expect": 5}])
    recheck(stream, "streamed", spark.range(2).toDF("id"), ledger, lambda n, r: told.append((n, r[0].ok)), str(tmp_path / "cp")).awaitTermination()
    assert told[-1][1]


def test_first_difference(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "b", "x", "d"]), (["a"], ["a"])], "a array<string>, b array<string>")
    rows = df.select(variants.first_difference(F.col("a"), F.col("b")).alias("d")).collect()
    assert rows[0].d.position == 3 and list(rows[0].d.ref) == ["b", "c", "d"]
    assert rows[1].d is None


def test_views_have_refs(made):
    assert [r.ref for r in store.views(made[3])["v_segment"].orderBy("id").limit(2).collect()] == ["Q1:1:1:1", "Q1:1:1:2"]


def test_command_line(made, capsys):
    from strataglyph import cli

    at = ["--store", str(made[0] / "out")]
    assert cli.main([*at, "stats"]) == 0
    assert cli.main([*at, "verify"]) == 0
    assert cli.main([*at, "counters"]) == 0
    assert cli.main([*at, "show", "Q1:1", "--level", "rasm"]) == 0
    assert cli.main([*at, "words", "Q1:1"]) == 0
    assert cli.main([*at, "search", "الله"]) == 0
    assert cli.main([*at, "root", "سمو"]) == 0
    assert cli.main([*at, "variants", "Q1"]) == 0
    assert cli.main([*at, "sql", "SELECT COUNT(*) FROM word"]) == 0
    assert cli.main([*at, "tree"]) == 0
    assert cli.main([*at, "sql", "SELECT x.token FROM ayah_text t, LATERAL tokens_of(t.plain) x", "--limit", "3"]) == 0
    assert cli.main([*at, "versions"]) == 0 and cli.main([*at, "expire"]) == 0 and cli.main([*at, "damaged", "--deep"]) == 0
    with pytest.raises(store.StoreError, match="no whole version nothing"):
        cli.main([*at, "publish", "nothing"])
    out = capsys.readouterr().out
    assert "1 in all" in out and "uthmani-warsh" in out and "… 14 more rows" in out


def test_checks_scan_each_table_once(made, monkeypatch):
    """The rows of every table but the index are read by one scan."""
    plans = []
    monkeypatch.setattr(checks, "kept", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), df)[1])
    checks.facts({n: made[3][n] for n in checks.PRIMARY_KEYS}, [2, 2], [1], [1, 2])
    assert len(plans) == 1 and plans[0].count("Relation [") == len(checks.PRIMARY_KEYS)

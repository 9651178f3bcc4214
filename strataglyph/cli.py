"""Command line over raw files and a compiled store."""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import serve
from .functions import tables
from .functions.ladder import LEVELS
from .operators import checks, claims
from .operators.api import Api
from .operators.export import export, totals
from .operators.search import SEARCHED
from .operators.sql import first_rows, read_only
from .plans.build import build
from .sources import raw, store

RLM = "‏"


def table(rows: list[dict]) -> None:
    for row in rows:
        print("  ".join("/" if v is None else f"{RLM}{v}" if isinstance(v, str) and not v.isascii() else str(v) for v in row.values()))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataglyph")
    top.add_argument("--store", default="data/store")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("lock", help="compare the raw files with the lock, or lock them anew")
    p.add_argument("declarations"), p.add_argument("raw"), p.add_argument("lock")
    p.add_argument("--relock", action="store_true")
    p = sub.add_parser("build")
    p.add_argument("raw"), p.add_argument("lock"), p.add_argument("plan", help="TOML with info, morphology and [[editions]]")
    p = sub.add_parser("fetch", help="download declared files that are missing")
    p.add_argument("declarations"), p.add_argument("raw"), p.add_argument("lock")
    p.add_argument("--force", action="store_true"), p.add_argument("--relock", action="store_true")
    p = sub.add_parser("serve", help="payloads over HTTP, on this machine only")
    p.add_argument("--port", type=int, default=8765)
    for name in ("verify", "stats", "counters", "exceptions", "tree"):
        sub.add_parser(name)
    p = sub.add_parser("claims")
    p.add_argument("folder")
    p = sub.add_parser("show")
    p.add_argument("ref"), p.add_argument("--edition", action="append"), p.add_argument("--level", choices=LEVELS, default="raw")
    p = sub.add_parser("words")
    p.add_argument("ref")
    p = sub.add_parser("search")
    p.add_argument("text"), p.add_argument("--level", choices=SEARCHED, default="rasm"), p.add_argument("--edition", default="uthmani-hafs"), p.add_argument("--limit", type=int, default=20)
    p = sub.add_parser("root")
    p.add_argument("root"), p.add_argument("--limit", type=int, default=30)
    p = sub.add_parser("variants")
    p.add_argument("ref"), p.add_argument("--all", action="store_true")
    p = sub.add_parser("sql")
    p.add_argument("query"), p.add_argument("--limit", type=int, default=50)
    sub.add_parser("versions")
    sub.add_parser("publish").add_argument("version")
    sub.add_parser("expire").add_argument("--keep", type=int, default=2)
    sub.add_parser("damaged").add_argument("--deep", action="store_true")
    p = sub.add_parser("export")
    p.add_argument("folder")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strataglyph").getOrCreate()
    if a.command == "lock":
        declared, found = raw.declarations(spark, a.declarations), raw.digests(spark, a.raw)
        if a.relock or not Path(a.lock).exists():
            raw.write_lock(declared, found, a.lock)
            return 0
        known = json.loads(Path(a.lock).read_text("utf-8"))["files"]
        wrong = raw.compare(declared, found, spark.createDataFrame([(k, f["sha256"]) for k, f in known.items()], "key string, sha256 string")).collect()
        table([r.asDict() for r in wrong])
        return int(bool(wrong))
    if a.command == "fetch":
        raw.fetch(spark, raw.declarations(spark, a.declarations), a.raw, a.lock, a.force, a.relock)
        return 0
    if a.command == "build":
        t = build(spark, a.raw, a.lock, tomllib.loads(Path(a.plan).read_text("utf-8")), a.store)
        table(Api(t).counters())
        return 0
    t = store.read(spark, a.store)
    api = Api(t)
    if a.command == "verify":
        expect = json.loads(next((r.value for r in t["build"].filter("key = 'expect'").collect()), "{}"))
        rows = checks.all_checks(t, expect, expect.get("verses"), expect.get("editions")).collect()
        table([{"ok": "ok" if r.ok else "FAILED", "name": r.name, "detail": r.detail} for r in rows])
        return int(not all(r.ok for r in rows))
    if a.command == "claims":
        results = claims.run(spark, claims.load(a.folder))
        table([{"ok": "ok" if r.ok else "FAILED", "id": r.claim.id, "actual": str(r.actual), "error": r.error} for r in results])
        return int(not all(r.ok for r in results))
    if a.command == "stats":
        table([{"table": k, "rows": v} for k, v in api.stats().items()])
        (share,) = t["word_text"].agg((100 * F.count(F.lit(1)) / F.greatest(F.lit(t["word"].count()), F.lit(1))).alias("p")).collect()
        print(f"{share.p:.2f} % of words aligned")
    elif a.command == "counters":
        table(api.counters())
    elif a.command == "serve":
        front = serve.server(api, a.port)
        print(f"http://127.0.0.1:{front.server_port}/")
        try:
            front.serve_forever()
        except KeyboardInterrupt:
            front.server_close()
    elif a.command == "show":
        table(api.show(a.ref, a.edition or ["uthmani-hafs"], a.level))
    elif a.command == "words":
        rows = api.words_of(*api.span(a.ref, None)).select("ayah_id", "position", "text_form", "form", "root", "lemma", "pos")
        table([r.asDict() for r in rows.toLocalIterator()])
    elif a.command == "search":
        got = api.search(a.text, a.level, a.edition)
        table([{"ref": h["ref"], "text": h["raw"]} for h in got["hits"][: max(0, a.limit)]])
        print(f"{got['total']} in all")
    elif a.command == "root":
        got = api.root(a.root)
        table([got["root"]] if got["root"] else got["like"])
        table(got["words"][: max(0, a.limit)])
    elif a.command == "variants":
        table(api.variants(a.ref, a.all))
    elif a.command == "sql":
        tables.register(spark)
        found = read_only(spark, a.query)
        rows, more = first_rows(found, max(0, a.limit))
        table([r.asDict() for r in rows])
        if more:
            print(f"… {found.count() - len(rows)} more rows")
    elif a.command == "versions":
        now = store.current(spark, a.store).rsplit("/", 1)[-1]
        table([{"version": n, "published": "yes" if n == now else ""} for n in store.versions(spark, a.store)])
    elif a.command == "publish":
        store.publish(spark, a.store, a.version)
    elif a.command == "expire":
        table([{"expired": n} for n in store.expire(spark, a.store, max(1, a.keep))])
    elif a.command == "damaged":
        wrong = store.damaged(spark, a.store, a.deep)
        table([{"damaged": n} for n in wrong])
        return int(bool(wrong))
    elif a.command == "export":
        total, largest = totals(export(t, a.folder))
        table([{"file": k, "bytes": v} for k, v in largest])
        print(f"{total} bytes in all")
    else:
        print(json.dumps(getattr(api, a.command)(), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())

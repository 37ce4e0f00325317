"""Operators 2, 5 and 6, the pipeline, and SQL twins."""

import glob
import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import op2_warc, op5_language, op6_urls
from lectern.llm import queries as q
from lectern.llm.common import Workspace, components, read_file

PAGES = [(k, f"http://a{k}.example.com/{k}", "<p>" + "page text " * (60 + k % 3) + "</p>") for k in range(60)]
PAGES += [(100, "http://x/\r\nWARC-Type: fake", "é" * 900), (101, None, "é" * 900), (102, "u", None), (103, "u", ""), (104, "u", "s" * 999), (105, "u", "s" * 999), (105, "u", "r" * 1000), (106, "u", "r" * 1000), (106, "u", "r" * 1000), (-7, "u", "r" * 1000), (None, "u", "r" * 1000)]


@pytest.fixture(scope="module")
def archive(spark):
    df = spark.createDataFrame([(k, u, h, 1) for k, u, h in PAGES], "page_id long, url string, html string, size int")
    return op2_warc.write_archives(Workspace(spark, "t2"), df)


def test_archives(archive):
    got = op2_warc.read_archives(archive).collect()
    best = {}
    for k, _, h in PAGES:
        if k is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, k), k)
    want = []
    for k, _, h in PAGES:
        raw = (h or "").encode()
        other = best[h] if len(raw) >= 1000 and k is not None and k < best[h] else None
        want.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other is not None else "response", other))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_archive_form(archive):
    seen = {}
    for row in archive.collect():
        data = read_file(row.path)
        assert data[:4] == bytes.fromhex("5d2a4d18")
        for key, url, payload, *_ in op2_warc.read_archive(data):
            seen.setdefault(key, []).append((url, payload))
    assert seen[101][0][0] is None
    assert seen[100][0][0] == "http://x/%0D%0AWARC-Type: fake"


@pytest.mark.parametrize("records", [1, 2, 12, 400])
def test_dictionaries_are_in_zstandards_format(records):
    some = [op2_warc.record(k, f"http://a/{k}", b"<p>%d</p>" % k * 9, 9, "ab" * 20, None, "2000-01-01T00:00:00Z") for k in range(records)]
    raw = op2_warc.train(some).as_bytes()
    assert raw[:4] == bytes.fromhex("37a430ec")


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert op2_warc.read_archives(op2_warc.write_archives(Workspace(spark, "t2e"), empty)).count() == 0


@pytest.mark.parametrize("key", [0, 1, -1, 2**63 - 1, -(2**63), None, 123456789])
def test_record_ids(key):
    assert op2_warc.key_of(op2_warc.record_id(key, "ab" * 20)) == key


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "lang").join(q.op5_language(spark, sf_dir), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9


def test_language_cases(spark):
    rows = [(k, "the cat sat on the mat and the dog ran", "en", "a") for k in range(30)] + [(100 + k, "le chat est sur la table et le chien court", "fr", "b") for k in range(30)]
    rows += [(900, None, "en", "c"), (901, "", None, "c"), (902, "123 !!", "fr", "c"), (903, "日本", None, "c"), (None, "le chat et le chien", None, "c"), (905, "the dog and the cat " * 9000, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score0 string")
    got = {r.doc_id: r for r in op5_language.identify(df).collect()}
    assert len(got) == len(rows) and got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und"
    assert got[None].lang_pred == "fr" and got[905].lang_pred == "en" and got[903].lang_pred in ("en", "fr") and got[900].score == 0
    assert {r.lang_pred for r in op5_language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert op5_language.identify(df.where("false")).count() == 0


def naive_length(learned: list[str], text: str, order: int) -> float:
    """Code length by the definition, context by context."""
    counts: dict[bytes, Counter] = {}
    for t in learned:
        data = b"\n" * order + t.encode()
        for at in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[at - k : at], Counter())[data[at]] += 1
    data, bits = b"\n" * order + text.encode(), 0.0
    for at in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts.get(data[at - k : at])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if seen[data[at]]:
                bits += np.log2(whole / seen[data[at]])
                break
            bits += np.log2(whole / len(seen))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize(("order", "block"), [(2, 1 << 18), (4, 1 << 18), (4, 7)])
def test_code_lengths_against_definition(monkeypatch, order, block):
    monkeypatch.setattr(op5_language, "BLOCK", block)
    monkeypatch.setattr(op5_language, "CELLS", 64)  # so that windows share places
    texts = {"a": ["aba abb, Ab. 12", "été\nbaba"], "b": ["ccc ab", "Zürich!"], "c": [""]}
    asked = ["aba", "x", "été abb ccc\n12 Zü", "日本 aba", "b" * 40]
    coder = op5_language.Coder(op5_language.Trees(texts, order=order))
    for _ in range(2):
        got = coder.lengths([t.encode() for t in asked])
        want = [[naive_length(texts[lang], t, order) for lang in sorted(texts)] for t in asked]
        assert np.allclose(got, want)


def test_language_columns_and_repeats(spark):
    rows = [(k % 5, "the cat and the dog" if k % 2 else "le chat et le chien", "en" if k % 2 else "fr", "old", "own") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE string, lang_pred string")
    got = op5_language.identify(df)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.count() == 30
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got.collect())


def test_urls_against_brute_force(spark, sf_dir):
    extra = [(9001, None), (9002, "nohost"), (9003, "HTTP://A.COM/en/?x=1"), (9004, "http://"), (9005, "http://example.net/de/8x"), (9006, "http://notexample.net/de/8"), (9007, "http://EXAMPLE.com/en/7#f"), (9008, "a://b://c/d"), (9009, "http://org?/es/"), (9001, None)]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    df = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string")).withColumn("host", F.lit("z"))
    got = op6_urls.judge(df, q.URL_RULES).collect()
    urls = [(r.page_id, r.url) for r in df.collect()]
    want = []
    for k, u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in q.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((k, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None))
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got))) == sorted(map(str, want))
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert op6_urls.judge(df.where("false"), q.URL_RULES).count() == 0


def test_trees_as_sql_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(op6_urls.NUMERIC)))
    y = (x[:, 0] + x[:, 3] > 1).astype("f8")
    base, trees = op6_urls.boost(x, y)
    model = op6_urls.Model(base, trees, {}, 0.5)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, " + ", ".join(f"{c} double" for c in op6_urls.NUMERIC))
    got = [r.s for r in df.select("k", model.score().alias("s")).orderBy("k").collect()]
    want = 1 / (1 + np.exp(-(base + sum(op6_urls.predict(t, x) for t in trees))))
    assert np.allclose(got, want) and np.mean((want > 0.5) == y) > 0.95


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (5, 4)] + [(100 + k, 101 + k) for k in range(40)] + [(1000, k) for k in range(2000, 2050)]
    got = {r.id: r.root for r in components(Workspace(spark, "cc"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[9] == 6 and got[5] == 4 and got[140] == 100 and got[2049] == 1000 and got[100] == 100
    assert components(Workspace(spark, "cc"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(90_000, None, "en", "s", 0), (90_001, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.where("doc_id >= 90000").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_keeps_what_no_stage_should_drop(spark, sf_dir):
    """Rows that share an id but not their text, repeated rows, null ids, clashing names, against a reading of the rules by hand."""
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"word{rng.integers(0, 5000)}" for _ in range(n))
    a, b, c, d = (text(80) for _ in range(4))
    near = a.replace(a.split()[40], "other")
    rows = [(1, a), (1, b), (2, near), (3, c), (3, c), (None, d), (None, c), (4, d), (5, "two words"), (6, ""), (7, None)]
    names = "row string, component string, pred string, score double, removed string, id string, first string, again string"
    df = spark.createDataFrame([(k, t, "en", len(t or ""), *["x"] * 3, 0.5, *["y"] * 4) for k, t in rows], f"doc_id long, text string, lang string, n_chars long, {names}")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["minhash_near_dedup"](spark, df, sf_dir)
    assert out.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (3, c), (4, d), (5, "two words"), (6, ""), (7, None)], key=str)
    for name in ("language_id", "substring_dedup"):
        out = stages[name](spark, df, sf_dir)
        assert out.columns == df.columns and out.dtypes == df.dtypes
    assert {r.doc_id for r in stages["language_id"](spark, df, sf_dir).collect()} == {1, 2, 3, 4, 5, None}
    for stage in stages.values():
        assert stage(spark, df.where("false"), sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = q.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = con.execute(q.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())

"""Operators 4, 7, 8 and 9 against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import op4_minhash, op7_spans, op8_ann, op9_itq

random.seed(5)
VOCAB = [f"w{k}" for k in range(900)]
DOCS = []
for g in range(12):
    base = [random.choice(VOCAB) for _ in range(random.randint(30, 160))]
    DOCS.append((len(DOCS), " ".join(base)))
    for _ in range(g):
        DOCS.append((len(DOCS), " ".join(random.choice(VOCAB) if random.random() < random.choice([0, 0.01, 0.04, 0.08]) else w for w in base)))
DOCS += [(500, None), (501, ""), (502, " \t"), (503, "One"), (504, "one"), (505, "a b"), (505, "a b"), (None, "a b"), (507, "x " * 20000)]


def brute(size):
    sets = {}
    for k, t in DOCS:
        w = (t or "").encode().lower().split()
        if k is not None:
            sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize(("size", "chunk"), [(2, 1024), (2, 4), (5, 1024)])
def test_near_duplicates(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(op4_minhash, "CHUNK", chunk)
    rows = spark.createDataFrame([(k, t, 1, "z") for k, t in DOCS], "doc_id long, text string, id int, key string")
    got = op4_minhash.near_duplicates(rows, size=size).collect()
    want = brute(size)
    assert len(got) == len(DOCS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


@pytest.mark.parametrize("shingles", [1 << 21, 300])
def test_one_hot_group(spark, monkeypatch, shingles):
    """A third of all rows near copies of one text, some of them far from its middle, in chunks of few shingles."""
    monkeypatch.setattr(op4_minhash, "SHINGLES", shingles)
    rng = random.Random(2)
    base = [f"h{k}" for k in range(60)]
    texts = [" ".join("z" + str(rng.random()) if rng.random() < 0.03 * (k % 3) else w for w in base) for k in range(120)]
    texts += [" ".join(rng.choice(VOCAB) for _ in range(40)) for _ in range(240)]
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for t in texts)]
    linked = np.array([[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets])
    np.fill_diagonal(linked, False)
    got = {r.doc_id: r.component_id for r in op4_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2).collect()}
    assert [got[k] for k in range(len(texts))] == op9_itq.smallest(linked, np.arange(len(texts))).tolist()


def test_linked_pairs_are_exact():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 60, 300, dtype="u8"))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.2], rng.integers(0, 1 << 60, 9, dtype="u8")])) for _ in range(40)]
    want = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    got = op4_minhash.linked_pairs(sets, 80)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == want[off]).all()
    assert (op4_minhash.linked_pairs(sets, 80, 7) == want[:7, 7:]).all()


def test_spans_against_brute_force(spark):
    words = [f"term{k}" for k in range(400)]

    def prose(n):
        return " ".join(" ".join(random.choice(words) for _ in range(random.randint(4, 12))).capitalize() + "." for _ in range(n))

    passage = prose(9)
    rows = [(k, prose(8) + (" and then " + passage if k % 3 == 0 else "") + " " + prose(6)) for k in range(30)]
    rows += [(100, rows[1][1]), (101, None), (102, ""), (103, "Short text."), (104, rows[1][1]), (104, rows[1][1]), (None, "Lone words here stand. So do these words.")]
    df = spark.createDataFrame([(k, t, "u", 1) for k, t in rows], "doc_id long, text string, uid string, span int")
    got = op7_spans.remove_repeats(df).collect()
    first = {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = Counter()
    for k, t in order:
        for h, lo, _ in op7_spans.runs(t):
            first.setdefault(h, (k, lo))
    for k, t in rows:
        spans = [lo << 32 | hi for h, lo, hi in op7_spans.runs(t) if first[h] != (k, lo)]
        want[(k, op7_spans.without(t, spans)[0] if spans else t)] += 1
    assert Counter((r.doc_id, r.text) for r in got) == want
    left = [r.text for r in got if r.doc_id is not None and r.doc_id % 3 == 0 and 0 < r.doc_id < 30]
    tail = passage.split(". ")[4]
    assert not any(tail in t for t in left) and tail in next(r.text for r in got if r.doc_id == 0)
    assert next(r.text for r in got if r.doc_id == 100).strip() == ""
    assert next(r for r in got if r.doc_id == 2).removed_chars == 0


def test_spans_against_own_reading(spark):
    """All runs of plain lower-case sentences, tried one by one, without the operator's code."""
    rng = random.Random(9)
    sentence = lambda: " ".join(rng.choice("alpha beta gamma delta kappa omega sigma".split()) + str(rng.randrange(900)) for _ in range(rng.randrange(2, 14))) + "."
    shared = [[sentence() for _ in range(n)] for n in (1, 2, 3, 5, 9)]
    docs = []
    for _ in range(40):
        body = [[sentence() for _ in range(rng.randrange(1, 5))], rng.choice(shared), [sentence()], rng.choice(shared), [sentence()]]
        docs.append([s for part in body for s in part])
    size = lambda run: sum(len(s.split()) for s in run)

    def large(run):
        return size(run) >= 32 or (size(run) >= 16 and len(run) >= 2)

    def runs(doc):
        for i in range(len(doc)):
            for j in range(i + 1, len(doc) + 1):
                run = doc[i:j]
                # least runs: no longer ones than needed from their start or to their end
                if large(run) and (not large(run[:-1]) or not large(run[1:])):
                    yield i, j, tuple(run)

    first = {}
    for k, doc in enumerate(docs):
        for i, _, run in runs(doc):
            first.setdefault(run, (k, i))
    want = {}
    for k, doc in enumerate(docs):
        gone = {x for i, j, run in runs(doc) if first[run] != (k, i) for x in range(i, j)}
        want[k] = [s for x, s in enumerate(doc) if x not in gone]
    assert 0 < sum(len(docs[k]) - len(want[k]) for k in want)
    got = op7_spans.remove_repeats(spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text.split() for r in got} == {k: " ".join(w).split() for k, w in want.items()}


def test_spans_columns_and_repeats(spark):
    body = " ".join(f"Sentence number {k} of a text stands here." for k in range(12))
    rows = [(7, body, "a"), (7, "Other words of the same id. " + body, "b"), (7, body, "c"), (8, body, "d"), (8, body, "d"), (None, None, "e")]
    df = spark.createDataFrame([(*r, "x", "y", "z", 5) for r in rows], "doc_id long, text string, uid string, spans string, doc string, h1 string, REMOVED_CHARS int")
    got = op7_spans.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "uid", "spans", "doc", "h1", "removed_chars"]
    found = {(r.doc_id, r.uid): (r.text, r.removed_chars) for r in got.collect()}
    whole = [k for k, (t, _) in found.items() if t == dict((r[2], r[1]) for r in rows)[k[1]]]
    assert (None, "e") in whole and ((7, "a") in whole) == ((7, "c") in whole) and ((7, "a") in whole) != ((7, "b") in whole)
    assert found[(8, "d")][0].strip() == "" and got.count() == len(rows)


@pytest.mark.parametrize("line", ["* x{} y{}", "Smith x{}", "the x{},", "| {}", "1. a{}", "le {} de,"])
def test_spans_of_short_lines(spark, line):
    passage = "\n".join(line.format(k, k + 1) for k in range(60))
    rows = [(k, f"Words of document {k} stand here\n{passage}\nother words end document {k}") for k in range(3)]
    got = {r.doc_id: r.text for r in op7_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for k in (1, 2):
        assert got[k].split() == f"Words of document {k} stand here other words end document {k}".split()


@pytest.mark.parametrize("sizes", [(33, 31), (20, 20, 3, 31), (40, 5), (9, 9, 9)])
def test_spans_leave_no_end(sizes):
    """A shared passage goes whole, also where no run from a sentence ends with it."""
    passage = " ".join(" ".join(["S" + f"t{k}"] + [f"w{k}x{i}" for i in range(n - 1)]) + "." for k, n in enumerate(sizes))
    texts = [f"First words {k} here. {passage} Then other{k} ones follow in text number {k} and so on." for k in range(2)]
    known = {h for h, *_ in op7_spans.runs(texts[0])}
    left, _ = op7_spans.without(texts[1], [lo << 32 | hi for h, lo, hi in op7_spans.runs(texts[1]) if h in known])
    assert not set(passage.split()) & set(left.split())


@pytest.mark.parametrize(("letters", "mark"), [("一丁七万丈三上下不与丑专且世丘丙业丛东丝", "。"), ("あいうえおかきくけこさしすせそたちつてと", "、"), ("กขคงจฉชซญฐณดตถทธนบปผ", " ")])
def test_spans_of_unspaced_scripts(letters, mark):
    rng = random.Random(4)
    passage = mark.join("".join(rng.choice(letters) for _ in range(24)) for _ in range(10))
    texts = ["".join(rng.choice(letters) for _ in range(30)) + (mark + passage + mark) + "".join(rng.choice(letters) for _ in range(30)) for _ in range(2)]
    known = {h for h, *_ in op7_spans.runs(texts[0])}
    left, _ = op7_spans.without(texts[1], [lo << 32 | hi for h, lo, hi in op7_spans.runs(texts[1]) if h in known])
    assert passage in texts[1] and len(left) <= 62


def vectors(n=700, dim=24):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, dim))
    x[50:80] = x[50] + 0.05 * rng.standard_normal((30, dim))
    x[90:95] = x[90]
    return [(int(k), [float(v) for v in row]) for k, row in enumerate(x)]


ODD = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] + [1.0] * 23), (2080, [float("inf")] * 24), (2100, []), (2101, [1.0] * 3)]


def test_neighbours(spark):
    rows = vectors()
    df = spark.createDataFrame([(k, v, "q") for k, v in rows + ODD], "vec_id long, embedding array<double>, t string")
    got = {}
    for r in op8_ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = np.array([v for _, v in rows])
    assert sorted(got) == [k for k, _ in rows if k % 20 == 0]
    hits = 0
    for k, found in got.items():
        found.sort()
        score = (x * x[k]).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(len(x)), -score)) if i != k][:20]
        hits += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("norms", ["one", "outlier", "lognormal"])
def test_neighbours_of_unequal_norms(spark, norms):
    rng = np.random.default_rng(12)
    n, dim = 6000, 32
    x = rng.standard_normal((120, dim))[rng.integers(0, 120, n)] + 0.5 * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "outlier":
        x[77] *= 5
    elif norms == "lognormal":
        x *= rng.lognormal(0, 0.5, (n, 1))
        x[77] *= 5
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in op8_ann.search(df, every=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for k in range(0, n, 60):
        score = x @ x[k]
        score[k] = -np.inf
        hits += len(got[k] & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * 100) >= 0.9


def test_few_neighbours(spark):
    df = spark.createDataFrame([(20 * k, [float(k), 1.0]) for k in range(5)], "vec_id long, embedding array<double>")
    got = op8_ann.search(df).collect()
    assert len(got) == 20 and {r["rank"] for r in got} == {1, 2, 3, 4}
    assert op8_ann.search(df.where("false")).count() == 0


def exact_neighbours(rows, every, k):
    """By definition: the nearest rows of the query's dimension, each id once with its best score."""
    want = {}
    for q, v in rows:
        if q % every == 0:
            best = {}
            for other, w in rows:
                if other != q and len(w) == len(v):
                    best[other] = max(best.get(other, -np.inf), float((np.array(w) * np.array(v)).sum()))
            want.setdefault(q, set()).add(tuple(sorted(best, key=lambda o: (-best[o], o))[:k]))
    return want


@pytest.mark.parametrize("clash", [False, True])
def test_neighbours_beyond_the_buckets(spark, monkeypatch, clash):
    """Ten rows in one cluster and many in the opposite one, ties, two dimensions: every query gets all it can have, exactly."""
    monkeypatch.setattr(op8_ann, "FEW", 4)
    monkeypatch.setattr(op8_ann, "CELL", 50)
    monkeypatch.setattr(op8_ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    near = np.array([1.0] + [0.0] * 7)
    rows = [(20 * k, (near + 0.01 * rng.standard_normal(8)).tolist()) for k in range(10)] + [(20 * k + 7, (-near + 0.01 * rng.standard_normal(8)).tolist()) for k in range(200)]
    rows += [(5, [1.0] * 8), (6, [1.0] * 8), (40_000, [1.0, 0.0, 0.0]), (40_001, [0.5, 0.0, 0.0]), (40_020, [0.0, 2.0, 1.0]), (40_040, [5.0])]
    df = spark.createDataFrame([(k, v, 1, "x", 0.5) for k, v in rows], "vec_id long, embedding array<double>, rank int, bucket string, score double" if clash else "vec_id long, embedding array<double>, a int, b string, c double")
    found = {}
    for r in op8_ann.search(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    want = exact_neighbours(rows, 20, 20)
    assert set(found) == {q for q, lists in want.items() if any(lists)} and 40_040 not in found
    assert all(tuple(found[q]) in want[q] or len(set(found[q]) & set(next(iter(want[q])))) >= 18 for q in found)
    assert all(len(found[q]) == len(next(iter(want[q]))) for q in found)


def test_neighbours_of_repeated_ids(spark):
    rows = [(k % 40, [float(k), 1.0 + k % 3]) for k in range(80)]
    got = op8_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id for r in got} == {0, 20}
    for q in (0, 20):
        own = [r.vec_id for r in got if r.query_id == q]
        assert q not in own and len(set(own)) >= 20


@pytest.mark.parametrize("width", [8, 12, 20])
def test_links_of_wide_substrings_and_several_dimensions(spark, monkeypatch, width):
    monkeypatch.setattr(op9_itq, "SUBSTRING", width)
    monkeypatch.setattr(op9_itq, "BLOCK", 8)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 32))
    x[300:] = x[:300] + 0.25 * rng.standard_normal((300, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    small = [(5000 + k, [1.0, 0.1 * k, 0.0]) for k in range(9)]
    more = [(5000, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(k, v, 1.0) for k, v in rows + small + more], "vec_id long, embedding array<double>, sub double")
    got = op9_itq.near_duplicates(df).collect()
    assert len(got) == 611
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    found = {r.vec_id: r for r in got}
    assert sum(found[k].n_links for k, _ in rows) >= 0.99 * linked.sum() and all(found[k].n_links <= linked[k].sum() for k, _ in rows)
    v = np.array([w for _, w in small])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    assert [found[k].n_links for k, _ in small[1:]] == [int(n.sum()) - 1 + int(n[0]) for n in near[1:]]
    assert found[5008].component_id == 5000 and found[None].n_links == 0 and found[None].component_id is None and not found[None].kept


@pytest.mark.parametrize("block", [1024, 16])
def test_linked_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(op9_itq, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows + ODD], "vec_id long, embedding array<double>, id int, n int")
    got = {r.vec_id: r for r in op9_itq.near_duplicates(df).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    low = op9_itq.smallest(linked, np.arange(len(u)))
    assert len(got) == len(rows) + len(ODD)
    assert [got[k].n_links for k, _ in rows] == linked.sum(axis=1).tolist()
    assert [got[k].component_id for k, _ in rows] == low.tolist()
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k, _ in ODD)


@pytest.mark.parametrize(("dim", "common", "block"), [(64, 0.0, 16), (64, 0.65, 16), (64, 0.82, 1024), (16, 0.0, 16), (24, 0.5, 16)])
def test_links_of_least_cosine(spark, monkeypatch, dim, common, block):
    """Pairs of cosine 0.90 to 0.95 around one shared direction: at least 99 of 100 are linked."""
    monkeypatch.setattr(op9_itq, "BLOCK", block)
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    m = unit(rng.standard_normal((1, dim)))
    own = lambda n: unit((v := rng.standard_normal((n, dim))) - (v @ m.T) * m)
    a = own(500)
    b = own(500)
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    inner = (rng.uniform(0.902, 0.948, (500, 1)) - common) / (1 - common)
    u = np.sqrt(common) * m + np.sqrt(1 - common) * np.vstack([a, inner * a + np.sqrt(1 - inner**2) * b])
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "vec_id long, embedding array<double>")
    got = op9_itq.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * linked.sum() <= got <= linked.sum()


def test_empty(spark):
    assert op9_itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert op4_minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert op7_spans.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0

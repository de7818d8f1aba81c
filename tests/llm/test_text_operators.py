"""Operators on document texts against brute force, and their edge cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clueframe.llm import components, near_dedup, scan
from clueframe.llm import decontaminate as dc
from clueframe.llm import quality_rules as qr

FOLD = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})
RAISE = str.maketrans({chr(x): chr(x - 32) for x in range(97, 123)})
SPACE, WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("module", [dc, qr])
def test_twins(spark, sf, sql, module):
    for name, f in module.QUERIES.items():
        df = f(spark, sf)
        rel = sql.execute(module.ORACLES[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in rel.fetchall())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1 \t\n|é_", max_size=20)), max_size=6), st.sampled_from([(SPACE, scan.NOT_SPACE), (WORD, scan.ALNUM)]))
def test_words(texts, kind):
    pattern, flags = kind
    column = pa.array(["x", *texts], pa.string())[1:]
    got = []
    for _, _, w in scan.scanned(column, flags, budget=7):
        h = w.hashes()
        for a, b in zip(w.rows[:-1], w.rows[1:]):
            got.append(([w.text(i, i + 1).decode() for i in range(a, b)], list(h[a:b])))
    want = [re.findall(pattern, (t or "").translate(FOLD)) for t in texts]
    assert [g[0] for g in got] == want
    by_word = {}
    for words, hashes in got:
        for x, y in zip(words, hashes, strict=True):
            assert by_word.setdefault(x, y) == y
    assert len(set(by_word.values())) == len(by_word)


def contaminated(rows, items, n=dc.N):
    grams = {}
    for i, t in items:
        w = re.findall(WORD, (t or "").translate(FOLD))
        for a in range(len(w) - min(n, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[a : a + min(n, len(w))]), set()).add(i)
    out = []
    for d, t in rows:
        w = re.findall(WORD, (t or "").translate(FOLD))
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in grams:
                    hit |= {*range(a, a + k)}
                    found |= grams[g]
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    rng = random.Random(5)
    words = "alpha beta Gamma delta 12 été x".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, text(14)), (2, text(11)), (10, "Short item."), (3, None), (4, ""), (5, "..."), (None, text(12)), (2, text(10))]
    rows = [(i, text(rng.randrange(30))) for i in range(30)] + [(40, f"{text(5)}, {items[0][1].translate(RAISE)}! {text(4)}"), (41, "a SHORT  item b"), (42, items[6][1]), (43, None), (44, ""), (41, "a SHORT  item b"), (None, items[1][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, contamination string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_contamination(docs, bench)
    assert found.columns == ["doc_id", "text", "items", "contamination"]
    got = sorted(((r.doc_id, r.contamination.n_words, r.contamination.n_hit, sorted(r.contamination["items"])) for r in found.collect()), key=str)
    assert got == contaminated(rows, items)
    clean = dc.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()}.isdisjoint({40, 41, 42, None})
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[41] == "a  b" and cut[43] is None and items[0][1].translate(RAISE) not in cut[40] and len(cut) == 36
    assert dc.find_contamination(docs.limit(0), bench).count() == 0 and dc.decontaminate(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_benchmarks_of_one_session(spark, monkeypatch, block):
    """Workers serve many jobs: none may see the items of another."""
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    monkeypatch.setattr(dc, "RUN_BYTES", 500)
    for k in range(10):
        items = [(j, " ".join(f"w{k}x{j}x{i}" for i in range(12))) for j in range(4)]
        docs = spark.createDataFrame([(j, f"before {t} after") for j, t in items] + [(9, "nothing of it")], "doc_id long, text string").coalesce(1)
        found = dc.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.contamination.n_hit, *r.contamination["items"]) for r in found} == {*((j, 12, str(j)) for j in range(4)), (9, 0)}


def test_contamination_in_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(10))
    long = "plain words here " * 200_000
    docs = spark.createDataFrame([(1, long + item + " " + long), (2, long)], "doc_id long, text string")
    found = {r.doc_id: r.contamination for r in dc.find_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).drop("text").collect()}
    assert found[1].n_words == 1_200_010 and found[1].spans == [(600_000, 600_009)] and found[2].n_hit == 0


def test_quality_edges(spark):
    good = "The house of the river and the hill is in a valley. " * 1 + " ".join(f"word{i} of the place{i}" for i in range(30)) + "."
    rows = [(1, good), (2, None), (3, ""), (4, "a b " * 200), (5, "| x " * 60), (1, good), (6, "\n".join([good] * 5)), (7, "\n \x0b\f" + "é" * 9)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, rules string")
    got = qr.quality_rules(df).collect()
    kept = [(r.doc_id, r.rules.kept) for r in got]
    assert kept == [(1, True), (2, False), (3, False), (4, False), (5, False), (1, True), (6, False), (7, False)]
    assert got[3].rules.n_repeat_words == 400 and got[6].rules.n_dup_lines == 4 and got[7].rules.n_words == 1 and got[7].rules.word_chars == 9
    assert "symbols_per_word" in got[4].rules.failed and qr.quality_rules(df.limit(0)).count() == 0
    plan = qr.quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        qr.verdict([qr.Rule("x", "nothing", "n_words", 1, 2)])


def near(rows, k, percent=80):
    sets, comp = {}, {}
    for i, t in rows:
        w = re.findall(SPACE, (t or "").translate(FOLD))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[i] = s
        comp[i] = i

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def check_near(spark, rows, k):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, shingle=k).collect()}
    want = near(rows, k)
    assert got == want
    kept = near_dedup.deduplicate(df, shingle=k)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if x[2])


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # so that buckets are compared in several blocks
    rng = random.Random(7)
    rows, i = [], 0
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
            rows.append((i, " ".join(w)))
            i += 1
    chain = [f"c{j}" for j in range(60)]
    for j in range(12):  # each is near the next, the first not near the last
        rows.append((i, " ".join(chain[3 * j :] + [f"d{j}_{x}" for x in range(0)] + [f"t{x}" for x in range(3 * j)])))
        i += 1
    rows += [(i + 1, None), (i + 2, ""), (i + 3, "one"), (i + 4, "ONE"), (i + 5, " \n"), (i + 6, "one two"), (i + 7, rows[0][1].translate(RAISE))]
    rng.shuffle(rows)
    check_near(spark, rows, 2)


def test_rows_sent_to_blocks_grow_with_the_group(spark, monkeypatch):
    """A large group of near copies, not all linked with the least: each row goes to few blocks, and no link is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{j}" for j in range(150)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.randrange(1, 5) if i % 12 else 14):
            w[rng.randrange(len(w))] = f"e{i}_{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    counts = {}
    stored = near_dedup.stored

    def counted(df, name, keep=False):
        out = stored(df, name, keep)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, shingle=2).collect()}
    assert got == near(rows, 2)
    assert counts["parts"] <= 2 * counts["members"]


def test_near_duplicates_of_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_near(spark, rows, 5)


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (None, "x y z"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, shingle=2).collect()), key=str)
    assert got == sorted([(None, 1, False), (1, 1, True), (None, None, False), (1, 1, True), (2, 2, True)], key=str)
    assert sorted((str(r.doc_id), str(r.text)) for r in near_dedup.deduplicate(df, shingle=2).collect()) in ([("1", "a b c"), ("2", "None")], [("1", "a b c"), ("2", "None"), ("None", "x y z")])
    assert near_dedup.near_duplicates(df.limit(0)).collect() == [] and near_dedup.deduplicate(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(j, j + 1) for j in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3), (7, None), (1, 0)]
    comp = {}

    def top(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            comp[y] = x
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in comp}
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_minima_are_set_minima():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 30_000, 7)]
    m = near_dedup.minima(sets)
    for s, row in zip(sets, m):
        x = (s >> np.uint64(32)).astype(np.uint32)
        assert (row == [(x * a + b).min() for a, b in zip(near_dedup._A, near_dedup._B)]).all()
    assert (near_dedup.minima(sets[::-1])[::-1] == m).all()


def test_items_digest(spark, tmp_path):
    spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "two"), (10, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in dc.op1_decontaminate(spark, str(tmp_path)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (3, 2, 2, True)
    assert got[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_deduplicate_null_ids(spark):
    long = [f"w{j}" for j in range(40)]
    near_a, near_b = " ".join(long), " ".join([*long[:-1], "other"])
    rows = [(None, "a b c"), (1, "a b c"), (None, "x y z"), (None, "p q r"), (None, "P q r"), (None, near_a), (None, near_b), (None, None), (None, ""), (2, "k l m")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, x int")
    got = near_dedup.deduplicate(df, shingle=2)
    assert got.columns == df.columns
    left = {r.x for r in got.collect()}
    assert left >= {1, 2, 7, 8, 9} and 0 not in left
    assert len(left & {3, 4}) == 1 and len(left & {5, 6}) == 1 and len(left) == 7
    # a near copy of an identified document goes, and joins what it is near to
    got = near_dedup.deduplicate(spark.createDataFrame([(7, near_a), (None, near_b), (None, "x y z")], "doc_id long, text string"), shingle=2)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("7", near_a), ("None", "x y z")]


def test_repeated_ids_join_their_texts(spark):
    a, b, c = "a b c d", "k l m n", "u v w x"
    rows = [(3, a), (5, a), (5, b), (7, b), (5, None), (9, c), (9, a.upper()), (11, "q r s"), (12, "z"), (12, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, shingle=2).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 3, False), (11, 11, True), (12, 12, True)}
    # two texts of one id as least of their classes, in buckets of several components
    words = [f"w{j}" for j in range(60)]
    texts = [" ".join([*words[:j], f"x{j}", *words[j + 1 :]]) for j in (5, 20, 35, 50)]
    rows = [(1, texts[0]), (1, " ".join(f"v{j}" for j in range(60))), (1, texts[1]), (2, texts[2]), (3, texts[3]), (None, texts[3])]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert len(found) == 6 and {r.component_id for r in found} == {1}

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clueframe.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(0, 3))
def test_within(a, b, k):
    assert ld.within(a, b, k) == (distance(a, b) <= k)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=6, max_size=14), st.text("abc", min_size=6, max_size=14), st.integers(1, 3))
def test_keys_meet(a, b, k):
    if distance(a, b) <= k:
        assert set(ld.keys_of(a, k)) & set(ld.keys_of(b, k))


def brute(rows, k, least):
    lines = [(i, n, x) for i, t in rows if t for n, x in enumerate(t.split("\n")) if x and not x.isspace()]
    texts = sorted({x for *_, x in lines})
    comp = {x: x for x in texts}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    near = set()
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if min(len(a), len(b)) >= least and distance(a, b) <= k:
                comp[top(a)] = top(b)
                near |= {a, b}
    first = {}
    for i, n, x in lines:
        at = (i is not None, i or 0, n)
        first[top(x)] = min(first.get(top(x), at), at)
    out = {}
    for i, _ in rows:
        mine = [x for j, _, x in lines if j == i]
        out[i] = (len(mine), sum(x in near for x in mine), sum(f[:2] == (i is not None, i or 0) for f in first.values()))
    return out


def edited(rng, line):
    x = list(line)
    for _ in range(rng.choice([0, 1, 2, 3])):
        p = rng.randrange(len(x))
        rng.choice([lambda: x.insert(p, "z"), lambda: x.pop(p), lambda: x.__setitem__(p, "é")])()
    return "".join(x)


def test_filter(spark, monkeypatch):
    digests = [ld._digest(str(i).encode()) for i in range(13_000)]
    df = spark.createDataFrame([(d,) for d in digests[:7000]], "digest binary")
    table = ld._filter(df, 7000)
    among = ld._among(table, digests)
    assert len(table) == 2 and among[:7000].all() and among[7000:].mean() < 0.02
    assert not ld._filter(df.limit(0), 0).any()
    monkeypatch.setattr(ld, "FILTER_BYTES", 8192)
    assert ld._filter(df, 7000) is None


@pytest.mark.parametrize("room", [ld.FILTER_BYTES, 0])
def test_against_brute_force(spark, monkeypatch, room):
    monkeypatch.setattr(ld, "FILTER_BYTES", room)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(4, 40))) + "x" for _ in range(12)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base)) for _ in range(rng.randrange(6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n\n\t"), (53, base[0] + "\n" + base[0]), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines, first = ld.line_classes(df)
    counts = {r[0]: (r[1], r[2]) for r in lines.groupBy("doc_id").agg({"line": "count"}).collect() for r in [(r[0], r[1], 0)]}
    near = {r.doc_id: r["count"] for r in lines.where("near").groupBy("doc_id").count().collect()}
    kept = {r.doc_id: r["count"] for r in first.groupBy("doc_id").count().collect()}
    got = {i: (counts.get(i, (0, 0))[0], near.get(i, 0), kept.get(i, 0)) for i, _ in rows}
    assert got == brute(rows, ld.THRESHOLD, ld.MIN_CHARS)
    cut = {r.doc_id: r.text for r in ld.dedup_lines(df).collect()}
    assert cut[None] == base[0] and cut[50] is None and cut[52] == " \n\n\t" and base[0] not in cut[53]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, line string, digest string")
    assert ld.dedup_lines(df).collect() == [] and ld.line_classes(df)[1].count() == 0


def test_rows_are_cut_by_themselves(spark):
    same, near = "a line that is long enough to be linked", "a line that is long enough to be linkEd"
    rows = [(None, f"n zero\n{same}\nn two"), (None, "m zero\nm one is unique here\nm two"), (None, f"o zero\n{near}"), (None, "m zero"), (4, f"p zero\n{same}"), (4, "q zero\nq one is unique too"), (4, "q zero\nr one"), (4, "q zero\nr one")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, x int")
    got = ld.dedup_lines(df)
    assert got.columns == df.columns
    cut = {r.x: r.text for r in got.collect()}
    assert {(cut[0], cut[2])} <= {(rows[0][1], "o zero"), ("n zero\nn two", rows[2][1])}
    assert {(cut[1], cut[3])} <= {(rows[1][1], ""), ("m one is unique here\nm two", "m zero")}
    assert cut[4] == "p zero" and [cut[i] for i in (5, 6, 7)] == [rows[i][1] for i in (5, 6, 7)]

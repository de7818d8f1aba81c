import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from clueframe.llm import kneser_ney as kn

FOLD = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), None]


def brute(train, texts):
    uni, pairs, docs = Counter(), Counter(), 0
    for t in train:
        before, docs = "<s>", docs + 1
        for x in tokens(t):
            uni[x] += 1
            pairs[before, x] += 1
            before = x
    n, v = sum(uni.values()), len(uni)
    t = Counter(w for _, w in pairs)
    total = Counter()
    follow = defaultdict(list)
    for (a, _), c in pairs.items():
        total[a] += c
        follow[a].append(c)
    times = lambda xs: [sum(x == k for x in xs) for k in (1, 2, 3, 4)]
    d2, d1 = kn.discounts(*times(pairs.values())), kn.discounts(*times(t.values()))
    cut = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    free = lambda xs, d: sum(d[min(x, 3) - 1] for x in xs)
    types = len(pairs)
    low, high = free(t.values(), d1), {a: free(xs, d2) for a, xs in follow.items()}
    out = []
    for text in texts:
        before, score, base, known = "<s>", 0.0, 0.0, 0
        ts = tokens(text)
        for x in ts:
            p = (low / types if types else 1.0) / (v + 1) + (cut(t[x], d1) / types if types else 0)
            if total[before]:
                p = cut(pairs[before, x], d2) / total[before] + high[before] / total[before] * p
            score += math.log10(p)
            base += math.log10((uni[x] + 1) / (n + v + 1))
            known += uni[x] > 0
            before = x
        out.append((len(ts), known, n, base, score))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    want = sorted(zip([-1 if i is None else i for i, _ in rows], brute(learn, [t for _, t in rows])))
    model = kn.train(df.where(~kn.held_out()))
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.n_tokens, r.n_known, model.n, r.base_score, r.score)) for r in kn.score(model, df).collect())
    for (i, x), (j, y) in zip(got, want, strict=True):
        assert i == j and x[:3] == y[:3]
        assert x[3:] == pytest.approx(y[3:], rel=1e-9)


def test_small(spark):
    check(spark, [(i, f"the cat {'sat on' if i % 3 else 'ran to'} the Mat {i % 5} x{i}") for i in range(40)] + [(50, None), (51, ""), (52, " \t"), (None, "the cat"), (3, "the cat")])


def test_documents(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_empty(spark):
    check(spark, [])


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b d a") for i in range(6)] + [(9, "b b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = kn.train(df)
    ask = spark.createDataFrame([(i, f"a {w}") for i, w in enumerate("a b c d unknown".split())], "doc_id long, text string")
    base = {r.doc_id: r.score for r in kn.score(model, ask).collect()}
    # P(start a) P(w | a) P(end | w): divide by the parts that (a) and (w) alone give
    assert len(base) == 5 and all(x < 0 for x in base.values())

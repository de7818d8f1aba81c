"""Trained operators: held-out accuracy, planted cases, brute force where the fit is exact, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clueframe.llm import hashed_text as ht
from clueframe.llm import language_id as li
from clueframe.llm import ordinal_quality as oq
from clueframe.llm import soft_mixing as sm

SCHEMA = "doc_id long, text string, quality string, __x int"
CLEAN, JUNK, RUDE = "the river runs by the old mill and the road goes {} up hill {}", "BUY NOW!! BUY NOW!! {} BUY NOW!! {}", "the river runs by the idiot and the moron goes {} up hill {}"


@pytest.fixture(scope="module")
def planted(spark):
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        rows.append((i, (CLEAN, RUDE, JUNK)[kind].format(f"w{i % 17}", f"v{i % 23}"), "x", 1))
        if i % 2:
            labels.append((i, int(kind < 2), int(kind == 1)))
    odd = [(1000, None, "x", 1), (1001, "", "x", 1), (1002, CLEAN.format("w1", "v1") * 3000, "x", 1), (1, rows[1][1], "x", 1), (None, CLEAN.format("w2", "v2"), "x", 1)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    return docs, spark.createDataFrame(labels + [(5000, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality_on_planted(spark, planted):
    docs, labels = planted
    scored = oq.score_quality(docs, oq.fit(docs, oq.graded(labels)))
    assert scored.columns == ["doc_id", "text", "__x", "quality"]
    rows = [r for r in scored.collect() if r.doc_id is not None and r.doc_id < 1000]
    assert all(r.quality.kept == (r.doc_id % 3 == 0) for r in rows)
    assert all(r.quality.tail[0] >= r.quality.tail[1] and abs(sum(r.quality.tail) - r.quality.expected_grade) < 1e-9 for r in rows)
    order = {k: np.mean([r.quality.expected_grade for r in rows if r.doc_id % 3 == k]) for k in range(3)}
    assert order[0] > order[1] > order[2]
    kept = oq.select_quality(docs, labels)
    assert kept.columns == docs.columns and 1002 in {r.doc_id for r in kept.collect()}


def test_quality_without_labels(spark, planted):
    docs, labels = planted
    none = oq.select_quality(docs, labels.limit(0))
    assert none.count() == docs.count() and oq.select_quality(docs.limit(0), labels).count() == 0
    one = oq.Ordinal([np.array([1], np.uint64)] * 3, np.array([1, 1, 1]))
    assert (one.tails(np.array([1], np.uint64), np.array([0, 1])) == [[1.0, 0.0]]).all()


def test_quality_on_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    graded = oq.graded(labels)
    learn = graded.where(F.col("doc_id") % 2 == 0)
    scored = oq.score_quality(docs, oq.fit(docs, learn)).join(graded.where(F.col("doc_id") % 2 == 1), "doc_id")
    got = {r.label: r.kept for r in scored.groupBy("label").agg(F.avg(F.col("quality.kept").cast("int")).alias("kept")).collect()}
    assert got[2] > 0.99 and got[0] < 0.03 and got[1] < 0.4


def test_ordinal_gradient():
    rng = np.random.default_rng(1)
    features = [np.unique(rng.integers(1, 40, 8).astype(np.uint64)) for _ in range(4000)]
    grades = np.array([min(2, int((f < 15).sum() // 2)) for f in features])
    model = oq.Ordinal(features, grades)
    assert model.theta[0] < model.theta[1]
    begins = np.cumsum([0, *map(len, features)])
    guess = (model.tails(np.concatenate(features), begins) >= 0.5).sum(axis=1)
    assert (guess == grades).mean() > 0.8


def brute_rates(p, n, goal, rounds=4000):
    """Plain projected gradient on the same objective, from 1."""
    w = n / n.sum()
    gram = (w[:, None] * p).T @ p
    step = np.linalg.pinv(gram, rcond=1e-6, hermitian=True)
    r = np.ones(len(p))
    for _ in range(rounds):
        r = np.maximum(0, r - p @ (step @ ((r * w) @ p - goal)))
    return (r * w) @ p


def test_rates_reach_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.3], 400)
    n = rng.integers(0, 500, 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
    for goal, anchor in (([0.5, 0.3, 0.2], None), ([0.2, 0.2, 0.6], 0), ([1.0, 0.0, 0.0], 0)):
        history, share, aim = sm.fit_rates(members, goal, anchor)
        rates = np.array([r.r for r in members.select(sm.rate(F.col("posteriors"), history).alias("r")).collect()])
        assert (rates >= 0).all() and np.allclose((rates * n / n.sum()) @ p, share, atol=1e-9)
        best = brute_rates(p, n, aim)
        assert np.abs(share - aim).max() <= np.abs(best - aim).max() + 0.02
        assert min(goal) == 0 or (np.abs(share - aim) <= sm.TOLERANCE * aim).all()  # a share of none can't be reached


def test_each_domain_is_held_to_its_own_target(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([3, 0.02, 0.1], 3000)
    members = spark.createDataFrame([(100, x.tolist()) for x in p], "n_tokens long, posteriors array<double>")
    history, share, aim = sm.fit_rates(members, [0.9, 0.002, 0.098])
    assert (np.abs(share - aim) <= sm.TOLERANCE * aim).all()
    p = 0.99 * np.eye(3)[rng.choice(3, 3000, p=[0.6, 0.15, 0.25])] + 0.01 / 3
    pure = spark.createDataFrame([(100, x.tolist()) for x in p], "n_tokens long, posteriors array<double>")
    history, share, aim = sm.fit_rates(pure, [0.5, 0.2, 0.3], 0, least=1.0)
    rates = np.array([r.r for r in pure.select(sm.rate(F.col("posteriors"), history, 1.0).alias("r")).collect()])
    assert rates.min() >= 1 and (np.abs(share - aim) <= sm.TOLERANCE * aim).all() and np.allclose(rates @ p / 3000, share)
    with pytest.warns(UserWarning, match="shares reached"):
        sm.fit_rates(members.where("posteriors[2] < 0.01"), [0.1, 0.1, 0.8])


def test_query_of_mixing(spark):
    """Rates of the query against plain projected gradient on its posteriors; these against labels that training hasn't seen."""
    sf = "/root/testdata/sf0.01"
    got = sm.op6_soft_mixing(spark, sf).orderBy("doc_id").collect()
    p = np.array([[r[f"p_{d}"] for d in sm.DOMAINS] for r in got])
    n = np.array([r.n_tokens for r in got], float)
    rates = np.array([r.rate for r in got])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert [r.n_tokens for r in got] == [len((texts[r.doc_id] or "").split(" ")) if not set(texts[r.doc_id] or "") & set("\t\n\x0b\x0c\r") else r.n_tokens for r in got]
    assert np.allclose(p.sum(axis=1), 1) and np.allclose([r.expected_tokens for r in got], rates * n)
    w = n / n.sum()
    goal = np.array([sm.TARGETS[d] for d in sm.DOMAINS])
    goal = goal * ((w @ p)[0] / goal[0])
    assert np.abs((rates * w) @ p - goal).max() <= np.abs(brute_rates(p, n, goal) - goal).max() + sm.TOLERANCE * goal.max()
    labels = {r.doc_id: r.label for r in sm.domains_of(spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.label is not None}
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0")
    model = sm.train(docs, sm.domains_of(spark.read.parquet(f"{sf}/labels.parquet")), 3)
    unseen = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 1")
    q = sm.memberships(unseen, model).collect()
    right = [int(np.argmax(r.membership.posteriors)) == labels[r.doc_id] for r in q if r.doc_id in labels]
    assert len(right) > 100 and np.mean(right) > 0.85


def test_mixing(spark, planted):
    docs, labels = planted
    kept = sm.mix(docs, labels, {"clean": 1.0}, rounding="nearest")
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and {i for i in range(300) if i % 3 == 0} <= set(ids) and not any(i is not None and i < 300 and i % 3 for i in ids)
    more = sm.mix(docs, labels, {"clean": 0.5, "toxic": 0.4, "poor": 0.1}, rounding="random")
    assert more.count() == more.count() and sm.mix(docs.limit(0), labels, {"clean": 1.0}).count() == 0
    assert sm.mix(docs, labels.limit(0), {"clean": 1.0}, rounding="nearest").count() == docs.count()


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.train(docs.where("doc_id % 2 = 0"))
    again = li.train(docs.where("doc_id % 2 = 0").repartition(23))
    assert again.languages == model.languages and (again.table == model.table).all()
    none = F.lit(None).cast("string")
    rows = docs.where("doc_id % 2 = 1").select("doc_id", F.col("lang").alias("truth"), F.struct("text", none.alias("declared"), none.alias("host"), none.alias("domain"), none.alias("suffix")).alias("evidence"))
    got = li.identify(rows, model, ("doc_id", "truth")).collect()
    assert len(got) == 500 and np.mean([r.lang == r.truth for r in got]) > 0.99
    assert all(abs(sum(r.posterior) - 1) < 1e-9 and r.probability == max(r.posterior) for r in got)


def test_fused_evidence(spark):
    docs = spark.createDataFrame([("the house and the river are with that " * 5, "en"), ("der fluss und das haus sind nicht " * 5, "de")], "text string, lang string")
    model = li.train(docs)
    page = lambda i, url, lang, body: (i, url, f"<html lang={lang}><script>das nicht</script><body>{body}</body>" if lang else body)
    rows = [page(i, f"https://news.a.de/{i}", "de", "der fluss und das haus") for i in range(6)]
    rows += [page(10, "http://u@NEWS.a.de:80/x", None, ""), page(11, None, None, None), page(12, "http://b.uk", "en", "the house and the river"), page(13, "http://c.a.de/", None, ""), page(14, "junk", "de", "")]
    x = li.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"))
    e = {r.page_id: r.evidence for r in x.collect()}
    assert (e[10].host, e[10].domain, e[10].suffix) == ("news.a.de", "a.de", "de") and e[11].host is None and e[0].declared == "de" and "nicht" not in e[0].text
    got = {r.page_id: r for r in li.identify(x, model, ("page_id",)).collect()}
    assert got[10].lang == "de" and got[10].probability > 0.9  # by its host alone
    assert got[13].lang == "de" and got[14].lang == "de" and got[12].lang == "en" and len(got) == len(rows)
    assert got[10].probability > got[13].probability
    empty = li.identify(x, li.train(docs.limit(0)), ("page_id",)).collect()
    assert {r.lang for r in empty} == {"und"} and li.identify(x.limit(0), model, ("page_id",)).collect() == []


def test_sample_is_bounded(spark, planted):
    docs, labels = planted
    features, y = ht.sample(docs, oq.graded(labels), rows=20)
    assert len(features) == len(y) <= 21
    again, z = ht.sample(docs.repartition(5), oq.graded(labels).repartition(3), rows=20)
    assert (y == z).all() and all((a == b).all() for a, b in zip(features, again))

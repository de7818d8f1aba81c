"""The pipeline: each stage on its own input, against plain versions of the same decision."""

import numpy as np
import pytest

import corpus_pipeline as cp
from clueframe.llm import decontaminate as dc
from test_text_operators import contaminated, near
from test_token_output import plain


@pytest.fixture(scope="module")
def steps(spark, sf):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(steps):
    assert all(s.columns == list(cp.COLUMNS) for s in steps[1:-1]) and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(steps[-1].columns)


def test_quality_keeps_most(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {i for i, _ in rows(cp.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))}
    sound = [i for i, x in labels.items() if x == (1, 0)]
    assert np.mean([i in kept for i in sound]) > 0.95 and np.mean([i in kept for i, x in labels.items() if x[0] == 0]) < 0.2


def test_one_of_each_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    want = {i for i, x in near(before, 5).items() if x[2]}
    assert sorted(i for i, _ in after) == sorted(want)


def test_contaminated_documents_go(spark, sf, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i for i, _, hit, _ in contaminated(rows(steps[2]), items, dc.N) if not hit}
    assert {i for i, _ in rows(steps[3])} == want


def test_mixing_repeats_or_drops_whole_rows(steps):
    before, after = dict(rows(steps[3])), rows(steps[4])
    assert all(before[i] == t for i, t in after) and len({i for i, _ in after}) > 0.8 * len(before)


def test_mixing_reaches_its_target(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = cp.mixing(spark, docs, sf).collect()
    counts = {}
    for r in mixed:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    before = docs.collect()
    assert all(counts[r.doc_id] >= 1 for r in before) and len(mixed) > 1.05 * len(before)
    tokens = {x: sum(len((r.text or "").split()) for r in mixed if r.lang == x) for x in cp.MIX}
    for x, share in cp.MIX.items():  # whole copies of some hundred documents of unequal lengths
        assert abs(tokens[x] / sum(tokens.values()) - share) < 0.15 * share, (x, tokens)


def test_odd_rows_pass_all_stages(spark, sf):
    rows = [(None, "no id", "en", "s", 5), (None, None, None, None, None), (1, "", "en", "s", 0), (2, "x" * 100_000, "xx", None, 1), (3, "same words twice here", "de", "s", 1), (3, "same words twice here", "de", "s", 1), (4, "same words twice here", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.limit(0)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    assert ids(cp.near_duplicates(spark, docs, sf)) == [1, 2, 3, None, None]
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, empty, sf).collect() == [] and stage(spark, docs, sf).columns == list(cp.COLUMNS)
        if name in ("quality", "decontamination", "mixing"):
            assert ids(stage(spark, docs, sf)) == [1, 2, 3, 3, 4, None, None], name
    assert cp.tokens(spark, empty, sf).collect() == [] and ids(cp.tokens(spark, docs, sf)) == [1, 2, 3, 3, 4, None, None]


def test_tokens(steps):
    got = [tuple(r) for r in steps[5].select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == plain(rows(steps[4]))


def test_run(spark, sf, steps):
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, steps[5].collect()))

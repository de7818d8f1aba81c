import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clueframe.llm import range_coder as rc
from clueframe.llm import token_output as to


@pytest.fixture(scope="module")
def encoder():
    return to.Encoder(to.vocabulary_path())


def plain(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(to.vocabulary_path())
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def check(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    to.write_tokens(df, f"file://{tmp_path}/t")
    got = [tuple(r) for r in to.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()]
    assert got == plain(rows)


def test_documents(spark, sf, tmp_path):
    check(spark, tmp_path, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_odd_texts(spark, tmp_path):
    check(spark, tmp_path, [(1, None), (2, ""), (3, " \n"), (4, "It's été  x y ΣΑΣ"), (5, "a<|startoftext|>b <|endoftext|>"), (5, "again"), (None, "no id"), (7, "́ a\x1cb 12345 !!??")])


def test_parts_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(to.scan.Words, "hashes", lambda self, first=None: np.minimum(self.ends - self.starts, 4).astype(np.uint64) & np.uint64(1))
    texts = ["one two three four five six seven", "it's Été, naïve? x1y22 ... seven", "one", None, "#a #b <|endoftext|> ǅ İ ﬁ ½"]
    e = to.Encoder(to.vocabulary_path())
    got = [x for ids, n in e.rows(pa.array(texts), 2) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert [x.tolist() for x in got] == [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x250, exclude_characters="\t\n\x0b\x0c\r "), st.sampled_from("aB1'é<|\u0301K½ⅣΣ"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=12))
def test_parts_have_the_library_ids(encoder, text):
    assert encoder.quick
    for part in re.findall(r"[^\x20\x09-\x0D]+", text):
        assert encoder.parts([part, "x"])[0].tolist()[:-1] == encoder.tokenizer.encode(part, add_special_tokens=False).ids


def test_rows_of_one_id_are_dealt_to_many_ranges(spark, tmp_path):
    rows = [(i, t) for i in (None, 7) for t in ["the same text"] * 300 + [f"{k} text" for k in range(300)]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, tmp_path, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = [r.n for r in spark.read.parquet(f"file://{tmp_path}/t").groupBy("shard").agg(F.sum("n_docs").alias("n")).collect()]
    assert len(per) == 4 and max(per) < 500


def test_a_very_long_text(spark, tmp_path):
    check(spark, tmp_path, [(1, "a" * 300_000), (2, "many words of it, " * 60_000), (3, "1" * 50_000)])


def test_empty(spark, tmp_path):
    check(spark, tmp_path, [])


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 511, 512, 513, 2049, 9000, 20001])
def test_round_trip(monkeypatch, n, wide):
    monkeypatch.setattr(rc, "BLOCK", 7000)
    ids = (np.random.default_rng(n).zipf(1.3, n) % 60000).astype(np.uint32)
    if wide:
        ids = ids * np.uint32(70001) + np.uint32(65000)
    packed = rc.pack([1, None], np.array([n // 2, n - n // 2]), ids)
    docs, lengths, back = rc.unpack(packed)
    assert docs == [1, None] and lengths.sum() == n and (back == ids).all()
    if n > 100:
        assert wide or n < 2000 or len(packed) < 2 * n
        bad = bytearray(packed)
        bad[-40] ^= 1
        with pytest.raises(ValueError):
            rc.unpack(bytes(bad))


def test_repeats_cost_little():
    assert len(rc.pack([1], np.array([50000]), np.full(50000, 7))) < 2000


def test_coding_holds_few_bytes_an_id():
    """Two blocks are coded at a time in each executor, beside all else that a pipeline's workers hold."""
    import tracemalloc

    ids = np.random.default_rng(1).integers(0, 49_000, 1 << 19).astype(np.uint32)
    tracemalloc.start()
    try:
        data = rc.encode_block(ids)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 28 * len(ids)
    assert (rc.decode_block(data, len(ids)) == ids).all()


def test_blocks_stand_alone(monkeypatch):
    monkeypatch.setattr(rc, "BLOCK", 4000)
    ids = np.random.default_rng(1).integers(0, 50, 10_000).astype(np.uint32)
    blocks, checks = rc.encode(ids)
    sizes = rc._sizes(len(ids))
    assert len(blocks) == 3 and (rc.decode(blocks[1:2], sizes[1:2], checks[1:2]) == ids[sizes[0] : sizes[0] + sizes[1]]).all()
    for at in (0, 5, 20, len(blocks[0]) - 9):
        bad = bytearray(blocks[0])
        bad[at] ^= 64
        with pytest.raises(ValueError):
            rc.decode([bytes(bad)], sizes[:1], checks[:1])


def test_orders_are_mixed():
    """Runs that each order predicts cost less than order 0 alone would."""
    rng = np.random.default_rng(2)
    order0 = rng.integers(0, 4000, 200_000)
    order1 = np.tile(rng.permutation(4000), 50)
    assert len(rc.pack([1], np.array([200_000]), order1)) < 0.25 * len(rc.pack([1], np.array([200_000]), order0))
    skewed = rng.zipf(1.5, 200_000) % 4000
    p = np.bincount(skewed) / 200_000
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * 200_000 / 8
    assert len(rc.pack([1], np.array([200_000]), skewed)) < 1.15 * entropy  # learning 4000 frequencies costs some of it

import statistics
from urllib.parse import parse_qs, quote

import numpy as np
from pyspark.sql import functions as F

from clueframe.functions import arrays, text
from clueframe.sources import knowledge


def test_array_statistics(spark):
    rng = np.random.default_rng(3)
    rows = [(1, [float(x) for x in rng.normal(1e3, 2, 50)]), (2, [1.0, None, 5.0, 5.0]), (3, []), (4, None), (5, [None])]
    e = F.col("e")
    x = spark.createDataFrame(rows, "k int, e array<double>").select("k", arrays.mean(e), arrays.deviation(e), arrays.first_largest(e), arrays.share_above(e, 2.0))
    got = {r[0]: tuple(r)[1:] for r in x.collect()}
    long = rows[0][1]
    assert np.allclose(got[1], (statistics.fmean(long), statistics.pstdev(long), long.index(max(long)) + 1, 100))
    assert np.allclose(got[2], (11 / 3, statistics.pstdev([1, 5, 5]), 3, 200 / 3))
    assert all(v is None for k in (3, 4, 5) for v in got[k])


def test_histogram(spark):
    rows = [("a", [-9.0, 0.0, 0.24, 0.25, 1.0]), ("a", [None, 0.99]), (None, [0.5]), ("b", None), ("c", [])]
    x = arrays.histogram(spark.createDataFrame(rows, "k string, e array<double>"), "k", "e", 0.0, 1.0, 4)
    assert sorted(map(tuple, x.collect()), key=str) == sorted([("a", 0, 3), ("a", 1, 1), ("a", 2, 0), ("a", 3, 2), (None, 0, 0), (None, 1, 0), (None, 2, 1), (None, 3, 0)], key=str)


def test_addresses(spark):
    texts = ["a b/c?é~*&+=%", "", "x_.-~ö漢"]
    x = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", text.url_quoted(F.col("t")))
    assert all(r[1] == (None if r[0] is None else quote(r[0])) for r in x.collect())
    urls = ["http://h/p?q=a%20b+c&q=2&z=1", "http://h/p", "/api?q=x", "http://h/?q=%zz", "no address : ?q=1", None]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(text.url_value(F.col("u"), "q")).collect()]
    assert got[0] == parse_qs("q=a%20b+c&q=2")["q"][0] and got[1:] == [None, "x", None, None, None]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x00\xff1")
    (tmp_path / "b.webp").write_bytes(b"x")
    (tmp_path / "empty.jpg").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r for r in knowledge.read_binary(spark, str(tmp_path)).select("path", "mime", "base64", knowledge.decoded(F.col("base64")).alias("raw")).collect()}
    assert (got["a.png"].mime, bytes(got["a.png"].raw)) == ("image/png", b"\x00\xff1") and got["b.webp"].mime == "image/webp" and len(got) == 2
    one = spark.range(1).select(knowledge.decoded(F.lit("data:image/png;base64,AP8x"))).first()[0]
    assert bytes(one) == b"\x00\xff1"

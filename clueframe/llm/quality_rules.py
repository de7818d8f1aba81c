"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is a built-in expression; no Python runs on the executors.

A text's words are its runs of characters other than space and \\t..\\r; a null
text has none.  Measures of a text:

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (``#*$%&|<>``),
  ``n_stop_words`` (words of ``STOP_WORDS``, lower case only),
* ``n_lines`` (lines that hold a word), ``n_dup_lines`` (of them, equal to an
  earlier line), ``n_end_lines`` (of them, closed by ``.!?:;"`` or a bracket),
* ``n_repeat_words`` (words in windows of three words found twice or more in the
  text, first ones included; windows are compared by 64-bit hash).

A rule is (name, numerator, denominator, least, most) and passes where
``least * denominator <= 1000 * numerator <= most * denominator``, so that all
arithmetic is on integers and a zero denominator passes whenever its numerator
is zero too.  Rows are never dropped: repeated rows are judged alike, an empty
or null text fails the base rule, and an input column of the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    numerator: str
    denominator: str
    least: int | None
    most: int | None


#: Common words of the four languages the corpus is written in.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by at are this from or an not which have "
    "der die das und ist von den mit sich des auf ein eine dem nicht als zu im "
    "le la les et un une des que est en du dans il pour au qui sur ne par "
    "el los las y del que se con para una por es lo su al"
).split()

#: Per mille of the denominator.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2500, 12000),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 250),
    Rule("stop_words", "n_stop_words", "n_words", 15, None),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 400),
    Rule("end_lines", "n_end_lines", "n_lines", 100, None),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SPACE = r"[\\x20\\x09-\\x0D]"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_end_lines", "n_repeat_words")


def measured(df: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """``df`` with a struct of its texts' measures, all long."""
    keep = [c for c in df.columns if c != into]
    own = "__quality_"
    e, names = F.expr, [F.col(f"`{c}`") for c in keep]
    carried = lambda *more: [*names, *(F.col(own + c) for c in more)]
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    t, w, g, s = (own + c for c in ("text", "words", "grams", "sorted"))
    x = df.select(*names, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    x = x.select(
        *carried("text"),
        e(f"filter(split({t}, '{_SPACE}+'), x -> x <> '')").alias(w),
        e(f"filter(split({t}, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias(own + "lines"),
    )
    x = x.select(
        *carried("words"),
        e(f"bigint(length({t}) - length(translate({t}, '#*$%&|<>', '')))").alias(own + "n_symbols"),
        e(f"bigint(length(translate({t}, ' \\u0009\\u000A\\u000B\\u000C\\u000D', '')))").alias(own + "word_chars"),
        e(f"bigint(size({own}lines))").alias(own + "n_lines"),
        e(f"bigint(size({own}lines) - size(array_distinct({own}lines)))").alias(own + "n_dup_lines"),
        e(f"bigint(size(filter({own}lines, x -> x rlike '[.!?:;\"\\')\\\\]]\\\\s*$')))").alias(own + "n_end_lines"),
        e(f"bigint(size(filter({w}, x -> x in ({stop}))))").alias(own + "n_stop_words"),
        e(f"if(size({w}) < 3, array(), transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))").alias(g),
    )
    rest = ("n_symbols", "word_chars", "n_lines", "n_dup_lines", "n_end_lines", "n_stop_words")
    x = x.select(
        *carried(*rest),
        e(f"bigint(size({w}))").alias(own + "n_words"),
        e(f"if(size(array_distinct({g})) < size({g}), sort_array(transform({g}, (h, i) -> struct(h as h, i as i))), array())").alias(s),
    )
    x = x.select(
        *carried(*rest, "n_words"),
        e(
            f"aggregate(sort_array(transform(filter({s}, (x, k) -> coalesce(x.h = get({s}, k - 1).h, false) or coalesce(x.h = get({s}, k + 1).h, false)), x -> x.i)), "
            "struct(-3 as last, 0L as total), (a, i) -> struct(i as last, a.total + least(3, i - a.last) as total), a -> a.total)"
        ).alias(own + "n_repeat_words"),
    )
    # A filter on the result must not be pushed below: it would evaluate the array steps again, one inside another.
    here = F.monotonically_increasing_id() >= 0
    return x.select(*names, F.when(here, F.struct(*(F.col(own + m).alias(m) for m in _MEASURES))).alias(into))


def verdict(rules: Sequence[Rule], measures: str = "measures") -> tuple[Column, Column]:
    """(passes all rules, names of the failed ones), compiled from the table."""
    failed = []
    for rule in rules:
        if not {rule.numerator, rule.denominator} <= set(_MEASURES):
            raise ValueError(f"{rule.name}: unknown measure")
        n, d = (F.col(f"`{measures}`.{c}") for c in (rule.numerator, rule.denominator))
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (n * 1000 < d * rule.least)
        if rule.most is not None:
            bad = bad | (n * 1000 > d * rule.most)
        failed.append((rule.name, bad))
    names = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in failed))) if failed else F.array().cast("array<string>")
    passes = F.lit(True)
    for _, bad in failed:
        passes = passes & ~bad
    return passes, names


def quality_rules(df: DataFrame, text: str = "text", into: str = "rules", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with a struct of measures, ``base_failed``, ``failed`` (names of rules) and ``kept``."""
    x = measured(df, text, into)
    m = lambda c: F.col(f"`{into}`.{c}")
    base = (m("n_words") < MIN_WORDS) | (m("n_repeat_words") * 100 > m("n_words") * MAX_REPEAT_PERCENT)
    passes, failed = verdict(rules, into)
    return x.withColumn(into, F.struct(*(m(c).alias(c) for c in _MEASURES), base.alias("base_failed"), failed.alias("failed"), (~base & passes).alias("kept")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = "rules.n_words rules.word_chars rules.n_symbols rules.n_dup_lines rules.n_repeat_words rules.base_failed rules.kept rules.n_lines rules.n_stop_words rules.n_end_lines".split()
    return quality_rules(docs).select("doc_id", *out)


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rules = []
    for r in RULES:
        rules += [f"1000 * {r.numerator} >= {r.least} * {r.denominator}"] * (r.least is not None) + [f"1000 * {r.numerator} <= {r.most} * {r.denominator}"] * (r.most is not None)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
        FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM d),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
        len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
        len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;"'')\]][ \t\n\x0B\f\r]*$')))::BIGINT AS n_end_lines
        FROM w LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(rules)} AS kept, n_lines, n_stop_words, n_end_lines FROM b"""


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": _sql()}

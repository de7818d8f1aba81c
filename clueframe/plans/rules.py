"""Rule tables compiled into projections.

A chain is an ordered list of arms, of which the first that applies counts.  An arm
applies where its condition holds (SQL over the observation's signals ``s`` and the
candidate ``c``) and, if it names codes, the candidate's code is one of them.  It adds points,
multiplies the score, and may give a reason.  A compiled set of chains is an expression over
an array of candidates: the number of the arm that applies in each chain, then the sum, product
and list of reasons, so that each condition is evaluated once for a candidate.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Arm(NamedTuple):
    when: str = "true"
    codes: str | Sequence[str] = ()
    add: float | str = 0.0  # points, or SQL that gives them
    mul: float = 1.0
    reason: str | None = None
    more: str = ""  # SQL of points that come on top

    def condition(self) -> str:
        codes = self.codes.split() if isinstance(self.codes, str) else self.codes
        return f"({self.when})" + (f" AND c.code IN ({', '.join(map(repr, codes))})" if codes else "")


Chains = Mapping[str, Sequence[Arm]]


def arm_number(arms: Sequence[Arm]) -> str:
    return "CASE " + " ".join(f"WHEN {a.condition()} THEN {i}" for i, a in enumerate(arms, 1)) + " ELSE 0 END"


def level(chains: Chains, name: str) -> str:
    """SQL of a value that stands for a metric of ``s`` in all comparisons of the chains: one for each number it is compared with, and for each gap."""
    at = sorted({float(n) for arms in chains.values() for a in arms for n in re.findall(rf"s\.{name} *[<>=]+ *(-?[\d.]+)", a.when)})
    if not at:
        return "0D"
    gaps = [at[0] - 1, *((a + b) / 2 for a, b in zip(at, at[1:]))]
    return "CASE " + " ".join(f"WHEN {name} < {t}D THEN {g}D WHEN {name} = {t}D THEN {t}D" for t, g in zip(at, gaps)) + f" ELSE {at[-1] + 1}D END"


def _of_candidate(sql: str) -> str:
    """The expression with the candidate as a field of ``x``."""
    return re.sub(r"(?<![\w.])c\.", "x.c.", sql)


def ranked_pool(
    chains: Chains,
    base: str,
    plus: str = "0D",
    times: str = "1D",
    where: str = "true",
    evidence: str = "NULL",
    then: Callable[[str], str] = str,
    why: Callable[[str], str] | None = str,
    need_reason: bool = False,
    first: Sequence[str] = (),
) -> Column:
    """The candidates of a row's array ``pool`` that pass ``where``, best first: structs of worse (0 - score), code, c, e and reasons.

    The whole choice is one expression over the row, so that it needs no crossing, sort or shuffle.  Expressions speak of the row's
    struct ``s``, a candidate ``c`` and its ``evidence`` ``e``.  score = then((base + sum of adds + plus) * product of muls * times);
    reasons come in the order of the chains, those of the chains named in ``first`` before all others, and then go through
    ``why`` (None: no reasons are made).  With ``need_reason``, candidates without a reason go.  Ties go by code.
    """
    adds, muls, reasons = [], [], {}
    for name, arms in chains.items():
        at = f"x.a.{name}"
        points = [f"WHEN {i} THEN CAST({a.add} AS DOUBLE)" + (f" + {a.more}" if a.more else "") for i, a in enumerate(arms, 1) if a.add or a.more]
        if points:
            adds.append(_of_candidate(f"CASE {at} {' '.join(points)} ELSE 0D END"))
        factors = [f"WHEN {i} THEN {a.mul}D" for i, a in enumerate(arms, 1) if a.mul != 1.0]
        if factors:
            muls.append(f"CASE {at} {' '.join(factors)} ELSE 1D END")
        texts = [f"""WHEN {i} THEN '{a.reason.replace("'", "''")}'""" for i, a in enumerate(arms, 1) if a.reason]
        if texts:
            reasons[name] = f"CASE {at} {' '.join(texts)} END"
    outer = lambda sql: re.sub(r"(?<![\w.])e\.", "x.e.", _of_candidate(sql))
    order = [*(n for n in first if n in reasons), *(n for n in reasons if n not in first)]
    listed = f"array_compact(array({', '.join(reasons[n] for n in order)}))" if order and why else "CAST(array() AS ARRAY<STRING>)"
    score = then(f"({' + '.join([outer(base), *adds, outer(plus)])}) * {' * '.join([*muls, outer(times)])}")
    arms = ", ".join(f"'{name}', {arm_number(arms)}" for name, arms in chains.items())
    numbered = f"transform(filter(pool, c -> {where}), c -> named_struct('c', c, 'e', {evidence}, 'a', named_struct({arms})))"
    made = f"named_struct('worse', 0D - {outer(score)}, 'code', x.c.code, 'c', x.c, 'e', x.e, 'reasons', {outer(why(listed)) if why else listed})"
    ranked = f"transform({numbered}, x -> {made})"
    if need_reason:
        ranked = f"filter({ranked}, y -> size(y.reasons) > 0)"
    # No two candidates have the same code, so that the order needs no more than the first two fields.
    return F.expr(f"array_sort({ranked}, (l, r) -> CASE WHEN l.worse < r.worse THEN -1 WHEN l.worse > r.worse THEN 1 WHEN l.code < r.code THEN -1 WHEN l.code > r.code THEN 1 ELSE 0 END)")


def pooled(candidates: DataFrame) -> DataFrame:
    """The candidates as one row with an array ``pool`` of structs.  Candidates are countries, of which there are some hundreds."""
    return candidates.groupBy().agg(F.collect_list(F.struct("*")).alias("pool"))

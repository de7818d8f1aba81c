"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "quality_rules",
    "decontaminate",
    "near_dedup",
    "kneser_ney",
    "token_output",
    "ordinal_quality",
    "soft_mixing",
    "language_id",
    "line_dedup",
    "warc",
)

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(f"clueframe.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

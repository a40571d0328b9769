"""Registry of this package's queries: ``name -> (callable, SQL or None)``."""

from __future__ import annotations

LLM_QUERIES: dict = {}


def llm_query(name: str, sql: str | None = None):
    def deco(fn):
        if name in LLM_QUERIES:
            raise ValueError(f"duplicate query {name}")
        LLM_QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_queries() -> dict:
    from . import (ann, collocations, decontaminate, fingerprints, kneser_ney,  # noqa: F401
                   language, middle, minhash, packing, pieces, secrets, sharding, urls)
    return LLM_QUERIES

"""Registered queries."""

from __future__ import annotations


def all_queries():
    from lexloom.plans import evidence_queries, index_queries, job_queries, lexicon_queries, linkage_queries, source_queries, stored_queries, word_queries  # noqa: F401
    from lexloom.plans.registry import QUERIES

    return QUERIES

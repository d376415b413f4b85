"""Imports every module that registers queries."""

from flowlens.plans import eval_queries, flow_queries, io_queries, split_queries  # noqa: F401

"""Corpus operators for training-data pipelines.

Each module holds one operator with its own general interface;
:mod:`rimward.llm.catalog` holds the thin queries built on them.
"""

"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
``opN_<name>`` queries, ``oracles`` their SQL.
"""

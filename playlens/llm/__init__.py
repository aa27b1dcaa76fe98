"""Operators of a training-data pipeline over large text, vector, page and chat tables.

Nothing outside this package imports it. Each module holds one operator with
its general interface; :mod:`playlens.llm.queries` has the thin queries that
apply them to whole tables.
"""

"""Operators of a training-data pipeline over documents, pages, conversations and embeddings.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` are picked up by
``__spark_entry__.py`` when the subpackage is present.
"""

from __future__ import annotations


def queries() -> dict:
    from specton.llm import registry as q

    return q.queries()


def oracle_sql() -> dict:
    from specton.llm import registry as q

    return q.oracle_sql()

"""Small tables and plain reference computations for the corpus operators."""

from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from texts, or from (doc_id, text) pairs; extra columns clash with results."""

    def build(*texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, None, "s", None if t is None else len(t), "x", -1) for i, t in rows]
        return spark.createDataFrame(full, DOC_SCHEMA + ", kept string, component_id int")

    return build


def groups_of(pairs, nodes):
    """The smallest reachable node of each node, by plain union."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}

"""Small helpers of the tests."""

from __future__ import annotations


def rows(df) -> set:
    """Rows as a set of tuples, lists as tuples."""
    fix = lambda v: tuple(map(fix, v)) if isinstance(v, (list, tuple)) else v
    got = [tuple(fix(v) for v in r) for r in df.collect()]
    assert len(got) == len(set(map(repr, got))), "a row twice"
    return set(got)

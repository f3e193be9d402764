"""What tests share."""

from __future__ import annotations


def told(rows, columns):
    """Rows as sorted tuples, with doubles cut to nine places."""
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)

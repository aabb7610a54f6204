"""Binding of intermediate values inside expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(values: list[Column], fn):
    """``fn`` of named values, each worked out once: a lambda over one struct binds them.

    Projections that are merged repeat an expression wherever its alias is used; chains of
    such uses grow exponentially, and this stops that.
    """
    names = [f"v{k}" for k in range(len(values))]
    bound = F.array(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
    return F.get(F.transform(bound, lambda s: fn([s[n] for n in names])), F.lit(0))

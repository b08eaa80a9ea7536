"""Pandas UDFs that are made at first use, so that modules can be imported before a session exists."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def lazy_udf(result: str, once: bool = False):
    """``once``: the planner takes the result for a new one each time, so that it never works it out twice for filters above."""

    def wrap(f):
        made: list = []

        @functools.wraps(f)
        def call(*columns):
            if not made:
                made.append(F.pandas_udf(f, result).asNondeterministic() if once else F.pandas_udf(f, result))
            return made[0](*columns)

        return call

    return wrap

"""Plan memo: a lazy DataFrame is built once per session and data directory.

Only the plan is kept, never data; building a wide plan costs thousands of driver calls.
"""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PLANS: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def plan_memo(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(fn)
    def build(spark: SparkSession, sf_dir: str, *args, **kwargs) -> DataFrame:
        if args or kwargs:
            return fn(spark, sf_dir, *args, **kwargs)
        plans = _PLANS.setdefault(spark, {})
        key = (fn.__module__, fn.__qualname__, sf_dir)
        if key not in plans:
            plans[key] = fn(spark, sf_dir)
        return plans[key]
    return build

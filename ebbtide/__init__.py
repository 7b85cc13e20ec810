"""Household attrition analytics as Spark DataFrame operators."""

from ebbtide.params import Params, read_params

__all__ = ["Params", "read_params"]

"""Operators: each is a function ``(DataFrame…, params) -> DataFrame``."""

from stockroom.operators.aggregates import *  # noqa: F401,F403
from stockroom.operators.joins import *  # noqa: F401,F403
from stockroom.operators.listings import *  # noqa: F401,F403

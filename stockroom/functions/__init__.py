from stockroom.functions.exprs import *  # noqa: F401,F403
from stockroom.functions.exprs import __all__  # noqa: F401

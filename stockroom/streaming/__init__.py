from stockroom.streaming.streams import *  # noqa: F401,F403

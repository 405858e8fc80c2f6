"""The same operators on streams."""

from .jobs import (
    match_stream,
    rate_limit_stream,
    register_stream,
    replay_stream,
)

__all__ = ["match_stream", "rate_limit_stream", "register_stream", "replay_stream"]

"""Live run telemetry with Structured Streaming."""

from .live import *  # noqa: F401,F403

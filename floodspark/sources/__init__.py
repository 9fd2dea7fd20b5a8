"""Readers and writers of scenario packages and run outputs."""

from .files import *  # noqa: F401,F403
from .sinks import *  # noqa: F401,F403

"""Column functions: Column in, Column out, all inside code generation."""

from .geometry import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
from .units import *  # noqa: F401,F403

"""Column functions."""

from tarnbeck.functions.scalar import *  # noqa: F403
from tarnbeck.functions.window import *  # noqa: F403

"""Named queries over the standard tables, with equivalent SQL where there is one."""

from . import basics, learning, networks, streams  # noqa: F401
from .registry import QUERIES, SQL

"""textloom: text retrieval and analytics as ordinary Spark plans."""

from textloom.engine import Engine
from textloom.session import get_session

__all__ = ["Engine", "get_session"]

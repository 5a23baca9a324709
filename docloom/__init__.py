"""Documentation-corpus analytics as PySpark DataFrame operators."""

from docloom.session import build_session

__all__ = ["build_session"]

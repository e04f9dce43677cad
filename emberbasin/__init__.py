"""Fire-detection and water-risk analytics as PySpark DataFrame operators."""

from emberbasin.session import build_session

__all__ = ["build_session"]

"""Named statements run through the SQL operator."""

from .delegated import STATEMENTS, oracle, run

__all__ = ["STATEMENTS", "oracle", "run"]

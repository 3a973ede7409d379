"""Logging as the flows use it."""

from __future__ import annotations

import logging


def configure_logging(level: int = logging.INFO, path: str | None = None) -> None:
    """Messages with time and level, to standard error or to a file."""
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(message)s", filename=path, force=True)

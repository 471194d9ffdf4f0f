"""Loggers that write one line a record, with the time and the name of the module."""

from __future__ import annotations

import logging
import sys


def get_logger(name: str, level: int = logging.INFO) -> logging.Logger:
    """The logger of that name; it gets its handler the first time it is asked for."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        lines = logging.StreamHandler(sys.stderr)
        lines.setFormatter(logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s", "%Y-%m-%d %H:%M:%S"))
        logger.addHandler(lines)
        logger.setLevel(level)
        logger.propagate = False
    return logger

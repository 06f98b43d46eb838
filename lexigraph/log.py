"""Logging of the driver program."""

from __future__ import annotations

import logging
import sys
from pathlib import Path


def setup(level: str = "INFO", file: str | None = None) -> logging.Logger:
    """The package's logger, on the console and, where named, in a file; calling again replaces its handlers."""
    log = logging.getLogger("lexigraph")
    log.setLevel(getattr(logging, level.upper(), logging.INFO))
    log.handlers.clear()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    return log

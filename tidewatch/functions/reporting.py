"""Logs and common arguments of the programs."""

from __future__ import annotations

import logging
from argparse import ArgumentParser, Namespace

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def arguments(parser: ArgumentParser) -> None:
    parser.add_argument("--verbose", action="store_true", help="log every alert and user too")
    parser.add_argument("--log-file", help="log to this file besides the console")
    parser.add_argument("--alias", action="append", default=[], metavar="NAME=SECTION", help="a name by which the settings file calls a section")


def aliases(given: Namespace) -> dict[str, str]:
    return dict(x.split("=", 1) for x in given.alias)


def set_up(level: str = "INFO", verbose: bool = False, file: str | None = None) -> None:
    """Handlers of the package's logger, in place of earlier ones."""
    log = logging.getLogger("tidewatch")
    log.setLevel(logging.DEBUG if verbose else level)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    for handler in (logging.StreamHandler(), *([logging.FileHandler(file, encoding="utf-8")] if file else [])):
        handler.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(handler)

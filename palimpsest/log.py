"""Log lines as JSON objects."""

from __future__ import annotations

import datetime
import json
import logging
import sys

LEVELS = {"DEBUG": logging.DEBUG, "INFO": logging.INFO, "WARNING": logging.WARNING, "ERROR": logging.ERROR}


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.datetime.fromtimestamp(record.created, datetime.UTC).isoformat()
        return json.dumps({"time": at, "level": record.levelname, "message": record.getMessage(), **getattr(record, "fields", {})}, default=str)


class JsonLogger:
    """``debug``, ``info``, ``warning`` and ``error`` with key-value arguments."""

    def __init__(self, name: str = "palimpsest", level: str = "INFO", stream=None):
        self.logger = logging.Logger(name, LEVELS[level])
        self.set_output(stream or sys.stderr)

    def set_output(self, stream) -> None:
        handler = logging.StreamHandler(stream)
        handler.setFormatter(_Json())
        self.logger.handlers = [handler]

    def debug(self, message: str, **fields) -> None:
        self.logger.debug(message, extra={"fields": fields})

    def info(self, message: str, **fields) -> None:
        self.logger.info(message, extra={"fields": fields})

    def warning(self, message: str, **fields) -> None:
        self.logger.warning(message, extra={"fields": fields})

    def error(self, message: str, **fields) -> None:
        self.logger.error(message, extra={"fields": fields})

"""Logs as lines of JSON, and the progress of streams among them."""

from __future__ import annotations

import datetime
import json
import logging
import sys
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

NAME = "pelorus"
#: What every record has; anything else was given as `extra`.
USUAL = set(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    """One object for each record: ts (UTC), level, logger, message, what was given as extra, and the error."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.datetime.fromtimestamp(record.created, datetime.UTC).isoformat(timespec="milliseconds")
        line = {"ts": at, "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage()}
        line |= {k: v for k, v in vars(record).items() if k not in USUAL}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, default=str)


def configure(level: str = "INFO", to: TextIO | None = None) -> logging.Logger:
    """The package's logger, writing lines of JSON to standard error or `to`; a second call replaces the first."""
    log = logging.getLogger(NAME)
    for old in list(log.handlers):
        log.removeHandler(old)
    handler = logging.StreamHandler(to or sys.stderr)
    handler.setFormatter(JsonLines())
    log.addHandler(handler)
    log.setLevel(level.upper())
    log.propagate = False
    return log


class StreamLog(StreamingQueryListener):
    """Start, progress and end of a session's streaming queries as records of the package's logger."""

    def __init__(self):
        self.log = logging.getLogger(f"{NAME}.stream")

    def onQueryStarted(self, event) -> None:
        self.log.info("started", extra={"query": str(event.id), "query_name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.log.info("progress", extra={"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "event_time": dict(p.eventTime or {})})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.log.log(logging.ERROR if event.exception else logging.INFO, "ended", extra={"query": str(event.id), "exception": event.exception})


def listen(spark: SparkSession) -> StreamLog:
    """Log the session's streams."""
    made = StreamLog()
    spark.streams.addListener(made)
    return made

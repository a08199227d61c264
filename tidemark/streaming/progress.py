"""A text log of what streams do, kept best effort: a line that cannot be written is lost, and nothing else."""

from __future__ import annotations

import json
import logging

from pyspark.sql.streaming.listener import StreamingQueryListener


def pipeline_log(path: str, name: str = "tidemark") -> logging.Logger:
    """A logger that appends lines with their time to a file of the driver."""
    logger = logging.getLogger(f"{name}:{path}")
    if not logger.handlers:
        try:
            handler: logging.Handler = logging.FileHandler(path, delay=True)
        except OSError:
            handler = logging.NullHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
        logger.propagate = False
    return logger


class ProgressLog(StreamingQueryListener):
    """Writes a line when a stream starts, ends and has finished a micro-batch."""

    def __init__(self, logger: logging.Logger):
        self.logger = logger

    def _say(self, what: str, **more) -> None:
        try:
            self.logger.info("%s %s", what, json.dumps(more, default=str))
        except Exception:  # the log must never stop a stream
            pass

    def onQueryStarted(self, event) -> None:
        self._say("started", id=event.id, name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._say("progress", id=p.id, batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._say("ended", id=event.id, error=event.exception)

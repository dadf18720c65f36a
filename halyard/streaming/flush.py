"""Background flushing: logged rows become snapshots every so often.

A reader of a collection's log pays for every open batch; the worker keeps their
number down. It compacts all collections with open batches each interval, one
failing collection does not keep the others, and stopping it flushes once more.
"""

from __future__ import annotations

import logging
import threading

from ..plans.collection import Engine

log = logging.getLogger(__name__)


class FlushWorker:
    """Flushes ``engine`` every ``interval`` seconds (the configured one unless
    given) from :meth:`start` to :meth:`stop`."""

    def __init__(self, engine: Engine, interval: float | None = None):
        self.engine = engine
        self.interval = engine.store.config.flush_interval if interval is None else interval
        self._stop, self._due = threading.Event(), threading.Event()
        self._thread: threading.Thread | None = None

    def start(self) -> FlushWorker:
        if self._thread is None:
            self._stop.clear()
            self._thread = threading.Thread(target=self._run, name="halyard-flush", daemon=True)
            self._thread.start()
        return self

    def flush_soon(self) -> None:
        """Don't wait for the interval to end."""
        self._due.set()

    def _run(self) -> None:
        while not self._stop.is_set():
            self._due.wait(self.interval)
            self._due.clear()
            try:
                self.engine.flush()
            except Exception:
                log.exception("flush failed; the next interval tries again")

    def stop(self) -> None:
        """Ends the worker after one more flush, so that nothing stays logged only."""
        if self._thread is None:
            return
        self._stop.set()
        self._due.set()
        self._thread.join()
        self._thread = None
        self.engine.flush()

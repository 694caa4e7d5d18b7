"""An ordered bus of handlers over event streams, and the progress of streams as Spark reports it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

Handler = Callable[[DataFrame, int], Any]


class Bus:
    """Handlers get the rows of a micro-batch that have their event type: those of a type in the order of their subscription, then those of all types. A handler that fails is counted and keeps nothing from the others."""

    def __init__(self, type_col: str = "event_type") -> None:
        self.type_col = type_col
        self._typed: dict[str, list[Handler]] = {}
        self._global: list[Handler] = []
        self._given = 0
        #: Batches that each handler took, and failed in, by its name.
        self.calls: Counter[str] = Counter()
        self.failures: Counter[str] = Counter()

    def subscribe(self, event_type: str, handler: Handler) -> int:
        self._typed.setdefault(event_type, []).append(handler)
        self._given += 1
        return self._given

    def subscribe_all(self, handler: Handler) -> int:
        self._global.append(handler)
        self._given += 1
        return self._given

    def unsubscribe(self, event_type: str, handler: Handler) -> bool:
        """Whether the handler was there; it is taken away once."""
        return self._removed(self._typed.get(event_type, []), handler)

    def unsubscribe_all(self, handler: Handler) -> bool:
        return self._removed(self._global, handler)

    @staticmethod
    def _removed(handlers: list[Handler], handler: Handler) -> bool:
        if handler not in handlers:
            return False
        handlers.remove(handler)
        return True

    def clear(self, event_type: str | None = None) -> None:
        """Without a type all handlers go."""
        if event_type is not None:
            self._typed[event_type] = []
        else:
            self._typed.clear()
            self._global.clear()

    def handler_count(self, event_type: str | None = None) -> int:
        return len(self._typed.get(event_type, [])) if event_type is not None else len(self._global) + sum(map(len, self._typed.values()))

    def publish(self, rows: DataFrame, number: int) -> int:
        """Give a batch to its handlers; returns how many took it. Types that nobody has subscribed to reach the global ones alone; a type without rows in the batch calls nobody."""
        taken = 0
        rows.persist()
        try:
            there = [r[0] for r in rows.select(self.type_col).where(F.col(self.type_col).isin([*self._typed])).distinct().collect()] if self._typed else []
            plan = [(h, rows.where(F.col(self.type_col) == t)) for t, handlers in self._typed.items() if t in there for h in [*handlers]]
            for handler, part in [*plan, *[(h, rows) for h in self._global]]:
                name = getattr(handler, "__name__", type(handler).__name__)
                try:
                    handler(part, number)
                except Exception:  # a handler's fault is its own
                    self.failures[name] += 1
                else:
                    self.calls[name] += 1
                    taken += 1
        finally:
            rows.unpersist()
        return taken

    def attach(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run the stream to its end through the bus."""
        return events.writeStream.foreachBatch(lambda batch, number: self.publish(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Progress of streams from Spark's own events: rows so far against an expected total, and each stream's end."""

    def __init__(self, totals: dict[str, int] | None = None) -> None:
        self.totals = totals or {}
        self.rows: Counter[str] = Counter()
        self.batches: Counter[str] = Counter()
        self.state: dict[str, str] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event: Any) -> None:
        self._names[str(event.id)] = event.name or str(event.id)
        self.state[self._names[str(event.id)]] = "running"

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] += p.numInputRows
        self.batches[name] += 1

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.state[self._names.get(str(event.id), str(event.id))] = "failed" if event.exception else "completed"

    def percent(self, name: str) -> float:
        """To one decimal; 100 once the stream has completed, 0 without a total."""
        if self.state.get(name) == "completed":
            return 100.0
        return round(100.0 * self.rows[name] / self.totals[name], 1) if self.totals.get(name) else 0.0

"""One stream with all that is known of a process when it starts.

``process_facts`` keeps, for each host, four maps: process id to its record,
image name to how often it was started, and the edges and nodes of the graph
of images that start each other. Every start gets its tracked parent, novelty,
siblings and the structural score of its edge, each read before it is taught.

Rows are held until the watermark has passed them and then taken in order of
(us, id), so a feed that is out of order by less than the watermark's delay
gives what the batch operators give; later rows are dropped by Spark and are
the batch job's (``jobs.split_late``). State of a process goes with its exit or
``forget_us`` after it was last touched; images, edges and nodes stay, as what
has been seen once is never new again.

A host's rows are one task's, as they follow one another. A host that is too
much for one task can be run through ``jobs.process_parents`` and
``jobs.image_sightings``, which deal a host's processes and images to tasks.
The state store must hold more than one map a key:
``spark.sql.streaming.stateStore.providerClass`` is RocksDB's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telarium.operators.facts import UNKNOWN_PARENT

#: The provider of state stores that this stream needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY, FORGET_US = "10 minutes", 30 * 86_400_000_000
FACTS = "id long, host string, us long, parent_id long, parent_image string, sighting long, image_is_novel boolean, siblings long, edge_score double"


class _Held:
    """A map in the state store, read once a key and written once a batch."""

    def __init__(self, state):
        self.state, self.seen, self.changed = state, {}, set()

    def get(self, *key):
        if key not in self.seen:
            self.seen[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.seen[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.seen[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            if self.seen[key] is not None:
                self.state.updateValue(key, self.seen[key])
            elif self.state.containsKey(key):
                self.state.removeKey(key)
        self.seen, self.changed = {}, set()


class ProcessState(StatefulProcessor):
    def __init__(self, forget_us: int = FORGET_US):
        self.forget_us = forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, kind string, pid long, parent_pid long, image string")
        self.processes = _Held(handle.getMapState("processes", "pid long", "id long, image string, children long, us long"))
        self.images = _Held(handle.getMapState("images", "name string", "n long"))
        self.edges = _Held(handle.getMapState("edges", "src string, dst string", "n long"))
        self.nodes = _Held(handle.getMapState("nodes", "node string", "n long"))
        self.swept = handle.getValueState("swept", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for batch in rows:
            held += [(int(us), int(i), kind, _int(pid), _int(parent), image) for us, i, kind, pid, parent, image in batch[["us", "id", "kind", "pid", "parent_pid", "image"]].itertuples(index=False, name=None)]
        yield from self._due(key[0], held, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(key[0], [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else [], timerValues)

    def close(self) -> None:
        pass

    def _due(self, host: str, held: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        """Takes the rows before the watermark, keeps the others, and asks to be called when the next is due."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held.sort(key=lambda r: r[:2])
        due = [r for r in held if r[0] < mark]
        left = held[len(due) :]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        out = [self._take(host, *row) for row in due]
        for held_map in (self.processes, self.images, self.edges, self.nodes):
            held_map.flush()
        if due:
            self._sweep(due[-1][0])
        yield pd.DataFrame([r for r in out if r is not None], columns=[f.split()[0] for f in FACTS.split(", ")]).astype({"parent_id": "Int64"})

    def _take(self, host: str, us: int, i: int, kind: str, pid: int | None, parent_pid: int | None, image: str | None) -> tuple | None:
        if kind == "process_exit":
            self.processes.put((pid,), None)
            return None
        parent = self.processes.get(parent_pid) if parent_pid is not None else None
        name = (image or "").lower()
        (seen,) = self.images.get(name) or (0,)
        self.images.put((name,), (seen + 1,))
        score = self._score(parent[1] if parent else UNKNOWN_PARENT, image or "") if parent_pid is not None else None
        siblings = parent[2] if parent else 0
        if parent:
            self.processes.put((parent_pid,), (parent[0], parent[1], siblings + 1, us))
        self.processes.put((pid,), (i, image, 0, us))
        return i, host, us, parent[0] if parent else None, parent[1] if parent else None, seen + 1, seen == 0, siblings, score

    def _score(self, src: str, dst: str) -> float:
        known, both = self.edges.get(src, dst), self.nodes.get(src) and self.nodes.get(dst)
        self.edges.put((src, dst), ((known or (0,))[0] + 1,))
        for node in (src, dst):
            self.nodes.put((node,), ((self.nodes.get(node) or (0,))[0] + 1,))
        return 0.0 if known else 0.5 if both else 1.0

    def _sweep(self, us: int) -> None:
        """Forgets processes that nothing has touched for ``forget_us``, four times in that span."""
        if self.swept.exists() and us - self.swept.get()[0] < self.forget_us // 4:
            return
        self.swept.update((us,))
        for key, value in [(tuple(k), tuple(v)) for k, v in self.processes.state.iterator()]:
            if us - value[3] > self.forget_us:
                self.processes.state.removeKey(key)


def _int(x) -> int | None:
    return None if pd.isna(x) else int(x)


def process_facts(events: DataFrame, delay: str = DELAY, forget_us: int = FORGET_US) -> DataFrame:
    """(id, host, us, parent_id, parent_image, sighting, image_is_novel, siblings, edge_score) of each process start.

    ``edge_score`` is null for a start that names no parent. As
    ``facts.with_facts`` and ``facts.edge_novelty`` of ``facts.process_edges``.
    """
    rows = events.where("kind IN ('process_start', 'process_exit')").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)
    rows = rows.select("host", "us", "id", "kind", "pid", "parent_pid", "image", "ts")
    return rows.groupBy("host").transformWithStateInPandas(ProcessState(forget_us), FACTS, "append", "EventTime")

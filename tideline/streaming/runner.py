"""Leading a pipeline: lease, heartbeat, resume decision, and the stream."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from .control import ControlStore, LeaseLost
from .observe import Health, Registry


@dataclass(frozen=True)
class Resume:
    """Where a leader starts: after which event, whether to snapshot anew, and the chunk to go on after."""

    position: str | None = None
    force_bootstrap: bool = False
    chunk_table: str | None = None
    chunk_key: str | None = None
    seq: int | None = None


def plan_resume(state: dict | None, offset: str | None, seq: int | None = None) -> Resume:
    """From the stored snapshot state and offset (its position, and the number of the event).

    A snapshot that never began, or was broken off in single mode, is taken anew. One in
    chunks goes on after its last chunk if the stream has an offset to go on from. A
    finished snapshot without an offset is worth nothing.
    """
    if state and state.get("phase") == "running" and state.get("mode") == "chunked" and offset:
        return Resume(offset, False, state.get("chunk_table"), state.get("chunk_key"), seq)
    if state and state.get("phase") == "done":
        return Resume(offset, not offset, seq=seq)
    return Resume(offset, True, seq=seq)


def capture_id(source: dict) -> str:
    """What identifies a capture at its source: a slot, a server id or a database."""
    kind = source.get("type", "")
    if kind in ("postgres", "postgresql"):
        return source.get("postgres", {}).get("slot", "")
    if kind == "mysql":
        return f"server_id={source.get('mysql', {}).get('server_id', 0)}"
    return source.get("mongodb", {}).get("database", "")


class SnapshotHooks:
    """Called by a source around its snapshot; each call is fenced."""

    def __init__(self, pipeline: str, holder: str, store: ControlStore, metrics: Registry, mode: str = "single"):
        self.pipeline, self.holder, self.store, self.metrics, self.mode = pipeline, holder, store, metrics, mode

    def started(self, slot: str = "", position: str = "") -> None:
        self.store.begin_snapshot(self.pipeline, self.holder, self.mode, slot, position)
        self.metrics.set("tideline_snapshot_running", 1, pipeline=self.pipeline)

    def rows(self, n: int) -> None:
        self.metrics.add("tideline_snapshot_rows_total", n, pipeline=self.pipeline)

    def chunk_accepted(self, table: str, key: str) -> None:
        """Only after every sink has the chunk's rows: progress never runs ahead of delivery."""
        self.store.save_chunk(self.pipeline, self.holder, table, key)
        self.metrics.add("tideline_snapshot_chunks_total", pipeline=self.pipeline)

    def completed(self, position: str = "") -> None:
        self.store.complete_snapshot(self.pipeline, self.holder, position)
        self.metrics.set("tideline_snapshot_running", 0, pipeline=self.pipeline)


class Runner:
    """One pipeline on one instance: stands by, leads while it holds the lease, and stands by again."""

    def __init__(self, pipeline: str, instance: str, store: ControlStore, work: Callable[[Resume, threading.Event], None], ttl: float = 10, renew: float | None = None, metrics: Registry | None = None, health: Health | None = None):
        self.pipeline, self.instance, self.store, self.work = pipeline, instance, store, work
        self.ttl, self.renew = ttl, renew or ttl / 3
        self.metrics, self.health = metrics or Registry(), health or Health()
        self.stopping = threading.Event()

    def stop(self) -> None:
        self.stopping.set()

    def run(self) -> None:
        self.health.set(self.pipeline)
        while not self.stopping.is_set():
            try:
                led = self.store.acquire(self.pipeline, self.instance, self.ttl)
            except Exception as e:  # noqa: BLE001  the store may be away for a while
                self.health.set(self.pipeline, last_error=str(e))
                led = False
            if led:
                self._lead()
            self.stopping.wait(self.renew)

    def _lead(self) -> None:
        self.metrics.set("tideline_leader", 1, pipeline=self.pipeline)
        self.health.set(self.pipeline, leader=True, streaming=True, last_error="")
        lost, over = threading.Event(), threading.Event()

        def beat() -> None:
            good = time.monotonic()
            while not over.wait(self.renew):
                try:
                    if not self.store.acquire(self.pipeline, self.instance, self.ttl):
                        break  # somebody else leads
                    good = time.monotonic()
                except Exception:  # noqa: BLE001  errors are borne while the lease lasts
                    if time.monotonic() - good >= self.ttl:
                        break
                if self.stopping.is_set():
                    break
            lost.set()

        heart = threading.Thread(target=beat, daemon=True)
        heart.start()
        try:
            plan = plan_resume(self.store.snapshot_state(self.pipeline), *(self.store.progress(self.pipeline) or (None, None)))
            self.work(plan, lost)
        except LeaseLost as e:
            self.health.set(self.pipeline, last_error=str(e))
        except Exception as e:  # noqa: BLE001  the pipeline starts again
            self.health.set(self.pipeline, last_error=str(e))
            self.metrics.add("tideline_pipeline_restarts_total", pipeline=self.pipeline)
        finally:
            over.set()
            heart.join()
            self.metrics.set("tideline_leader", 0, pipeline=self.pipeline)
            self.health.set(self.pipeline, leader=False, streaming=False)
            self.store.release(self.pipeline, self.instance)

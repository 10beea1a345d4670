"""Work in the background: submit, ask how far it is, cancel.

A task's Spark jobs carry its id as their group, so what runs, how many of its tasks
are done and what has to stop is asked of Spark itself; nothing is counted apart.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


class Cancelled(Exception):
    """The task was cancelled before it had a result."""


@dataclass
class Task:
    spark: SparkSession
    work: Callable[[], object]
    name: str = "task"
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "queued"
    error: str | None = None

    def __post_init__(self) -> None:
        self._result: object = None
        self._stop = threading.Event()
        self._thread = InheritableThread(target=self._run, daemon=True)

    def _run(self) -> None:
        try:
            if self._stop.is_set():
                raise Cancelled
            self.state = "running"
            self.spark.sparkContext.setJobGroup(self.id, self.name, interruptOnCancel=True)
            self._result = self.work()
            self.state = "cancelled" if self._stop.is_set() else "done"
        except Exception as e:  # noqa: BLE001 - told to whoever asks
            self.state, self.error = ("cancelled", None) if self._stop.is_set() else ("failed", f"{type(e).__name__}: {e}"[:2000])

    def start(self) -> Task:
        self._thread.start()
        return self

    def jobs(self) -> list[int]:
        """Jobs of this task that Spark runs now."""
        tracker = self.spark.sparkContext.statusTracker()
        return sorted(set(tracker.getJobIdsForGroup(self.id)) & set(tracker.getActiveJobsIds()))

    def status(self) -> dict:
        """State, error, and Spark's tasks of the jobs it still knows: done, running, all."""
        tracker = self.spark.sparkContext.statusTracker()
        infos = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.id)]
        stages = [tracker.getStageInfo(s) for s in {s for i in infos if i for s in i.stageIds}]
        there = [s for s in stages if s]
        return {
            "id": self.id, "name": self.name, "state": self.state, "error": self.error, "jobs": sum(i is not None for i in infos),
            "tasks_done": sum(s.numCompletedTasks for s in there), "tasks_running": sum(s.numActiveTasks for s in there), "tasks": sum(s.numTasks for s in there),
        }

    def cancel(self, patience: float = 30.0) -> bool:
        """Stop the task's jobs, also those that it starts before it notices; whether it has ended."""
        self._stop.set()
        until = time.monotonic() + patience
        while self._thread.is_alive() and time.monotonic() < until:
            self.spark.sparkContext.cancelJobGroup(self.id)
            self._thread.join(0.1)
        return not self._thread.is_alive()

    def result(self, timeout: float | None = None) -> object:
        """What the work gave, when it has ended; its failure as an error."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.id)
        if self.state == "cancelled":
            raise Cancelled(self.id)
        if self.state == "failed":
            raise RuntimeError(self.error)
        return self._result


class Tasks:
    """The tasks of a session by their ids."""

    def __init__(self, spark: SparkSession):
        self.spark, self._known = spark, {}

    def submit(self, work: Callable[[], object], name: str = "task") -> str:
        task = Task(self.spark, work, name)
        self._known[task.id] = task
        return task.start().id

    def submit_write(self, frame: Callable[[], DataFrame], path: str, name: str = "ranking") -> str:
        """A frame, such as a ranking, written to ``path`` as parquet; the task's result is the path."""

        def work() -> str:
            frame().write.mode("overwrite").parquet(path)
            return path

        return self.submit(work, name)

    def __getitem__(self, task_id: str) -> Task:
        return self._known[task_id]

    def status(self, task_id: str) -> dict:
        known = self._known.get(task_id)
        return known.status() if known else {"id": task_id, "state": "unknown"}

    def forget(self) -> None:
        """Drop the tasks that have ended, and their results."""
        self._known = {k: t for k, t in self._known.items() if t.state in ("queued", "running")}

"""What a run is doing, for whoever waits for it: finished tasks of its jobs and bytes fetched, without a job of its own.

    with progress.watched(spark, print):
        run.run(ctx)

A thread asks Spark's status tracker about the jobs of the caller's group and reads an accumulator that tasks add to; it
calls `tell` at most once an interval, only when something changed, and once at the end.
"""

from __future__ import annotations

import contextlib
import dataclasses
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark import Accumulator, SparkContext
from pyspark.sql import SparkSession

GROUP = "spark.jobGroup.id"


@dataclasses.dataclass(frozen=True)
class Snapshot:
    """Jobs begun and still running, tasks finished and known so far, and bytes fetched, all since the watch began."""

    jobs: int
    running: int
    tasks_done: int
    tasks: int
    bytes_fetched: int

    def __str__(self) -> str:
        return f"{self.tasks_done} of {self.tasks} tasks in {self.jobs} jobs, {self.running} running, {self.bytes_fetched} bytes fetched"


_fetched: dict[str, Accumulator] = {}


def fetched_bytes(sc: SparkContext) -> Accumulator:
    """The accumulator of bytes that tasks fetch, one a Spark application. A task that is run again may count twice."""
    return _fetched.setdefault(sc.applicationId, sc.accumulator(0))


class Watch:
    def __init__(self, sc: SparkContext, group: str) -> None:
        self.sc, self.group, self.begun = sc, group, fetched_bytes(sc).value
        #: Tasks of each stage as last seen: the tracker forgets old stages.
        self.stages: dict[int, tuple[int, int]] = {}

    def look(self) -> Snapshot:
        tracker = self.sc.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.group)
        running = 0
        for j in jobs:
            if (job := tracker.getJobInfo(j)) is None:
                continue
            running += job.status == "RUNNING"
            for s in job.stageIds:
                if (stage := tracker.getStageInfo(s)) is not None:
                    self.stages[s] = (stage.numCompletedTasks, stage.numTasks)
        done, known = (sum(v[i] for v in self.stages.values()) for i in (0, 1))
        return Snapshot(len(jobs), running, done, known, fetched_bytes(self.sc).value - self.begun)


@contextlib.contextmanager
def watched(spark: SparkSession, tell: Callable[[Snapshot], None], every: float = 1.0) -> Iterator[Watch]:
    """Tells about the jobs that the caller's thread starts within the block; its job group is as before afterwards."""
    sc = spark.sparkContext
    before = sc.getLocalProperty(GROUP)
    watch, over = Watch(sc, f"talweg-{uuid.uuid4().hex}"), threading.Event()

    def run() -> None:
        last = None
        while not over.wait(every):
            if (now := watch.look()) != last:
                tell(now)
                last = now

    sc.setLocalProperty(GROUP, watch.group)
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield watch
    finally:
        over.set()
        thread.join()
        sc.setLocalProperty(GROUP, before)
        tell(watch.look())

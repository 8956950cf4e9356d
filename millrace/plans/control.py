"""Running queries: ids, cancelling, progress and metrics."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from millrace.errors import InvalidParallelism, QueryCancelled
from millrace.functions.expressions import Expr
from millrace.plans.plan import BATCH_ROWS, Plan
from millrace.types import BOOLEAN


@dataclass
class Query:
    """One run of a plan in a thread of its own. Its jobs carry the query's id as their group.

    parallelism: tasks at most that a shuffle's reading stage and the last stage have, in this query alone; None leaves that to the session.
    """

    plan: Plan
    query_id: str = field(default_factory=lambda: f"millrace-{uuid.uuid4().hex[:12]}")
    parallelism: int | None = None
    seconds: float = 0.0
    rows: int = 0
    batches: int = 0

    def __post_init__(self) -> None:
        if self.parallelism is not None:
            self.plan = limited(self.plan, self.parallelism)
        self._cancelled, self._thread, self._error = threading.Event(), None, None

    def start(self, handler: Callable[[list[Row]], None], size: int = BATCH_ROWS) -> Query:
        sc = self.plan.frame.sparkSession.sparkContext

        def run() -> None:
            began = time.monotonic()
            sc.setJobGroup(self.query_id, self.plan.node, interruptOnCancel=True)
            try:
                for part in self.plan.batches(size):
                    if self._cancelled.is_set():
                        break
                    self.rows += len(part)
                    self.batches += 1
                    handler(part)
            except Exception as e:  # noqa: BLE001 - wait() raises it in the caller's thread
                self._error = e
            finally:
                self.seconds = time.monotonic() - began

        self._thread = InheritableThread(target=run, session=self.plan.frame.sparkSession)
        self._thread.start()
        return self

    def cancel(self) -> None:
        """Stops the query's jobs, and its handler before the next batch."""
        self._cancelled.set()
        self.plan.frame.sparkSession.sparkContext.cancelJobGroup(self.query_id)

    def wait(self, timeout: float | None = None) -> Query:
        """Returns when the query has ended, raises what it raised, or QueryCancelled."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.query_id)
        if self._cancelled.is_set():
            raise QueryCancelled(self.query_id)
        if self._error:
            raise self._error
        return self

    def progress(self) -> float:
        """From 0 to 1: the share of its known tasks that are done. It only rises while no new stages are planned."""
        tracker = self.plan.frame.sparkSession.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.query_id):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        if self._thread is not None and not self._thread.is_alive() and not self._error and not self._cancelled.is_set():
            return 1.0
        return done / total if total else 0.0


def limited(plan: Plan, tasks: int) -> Plan:
    """The plan in a session of its own with so many shuffle partitions, and no more tasks at its end."""
    if tasks < 1:
        raise InvalidParallelism(str(tasks))
    spark = plan.frame.sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", str(tasks))
    own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(tasks))
    jvm = spark.sparkContext._jvm
    frame = DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan.frame._jdf.queryExecution().logical()), own)
    return replace(plan, frame=frame.coalesce(tasks))


def expression_metrics(plan: Plan, *exprs: Expr) -> list[tuple[str, dict[str, float]]]:
    """(expression, rows it was computed for, those that it isn't null for or, if it is boolean, selects, and seconds) in a run over the plan
    for each: Spark compiles the expressions of a stage into one loop, so their times can't be told apart within one."""
    out = []
    for e in exprs:
        found = F.count_if(e.column) if e.type == BOOLEAN else F.count(e.column)
        began = time.monotonic()
        row = plan.frame.agg(F.count(F.lit(1)).alias("rows"), found.alias("selected")).first()
        out.append((e.label, {"rows": row["rows"], "selected": row["selected"], "seconds": time.monotonic() - began}))
    return out


def observed(plan: Plan, name: str | None = None) -> tuple[Plan, Observation]:
    """The plan, and what counts its rows while it runs: observation.get["rows"] once it has."""
    seen = Observation(name or f"rows-{uuid.uuid4().hex[:8]}")
    return Plan(plan.frame.observe(seen, F.count(F.lit(1)).alias("rows")), plan.fields, plan.node, plan.inputs), seen


def metrics(frame: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """(operator, metrics) of the physical plan of a DataFrame that has run, from the root down."""
    out: list[tuple[str, dict[str, int]]] = []

    def walk(node: object) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
            return
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            walk(node.plan())
            return
        values, it = {}, node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            values[pair._1()] = pair._2().value()
        out.append((name, values))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return out

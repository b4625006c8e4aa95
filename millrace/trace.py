"""What a query's operators did: rows and times by operator, read from Spark's own counters after it ran."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    depth: int
    operator: str
    rows: int | None  #: rows out, where the operator counts them
    ms: int | None  #: time in its own counters, over all tasks
    shuffled: int | None  #: bytes written by an exchange


#: Counters of time and shuffled bytes, by Spark's names.
_TIMES = ("pipelineTime", "scanTime", "sortTime", "aggTime", "buildTime", "collectTime", "broadcastTime")


def _value(metrics, name: str) -> int | None:
    found = metrics.get(name)
    return int(found.get().value()) if found.isDefined() else None


def _children(node) -> list:
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    if kind == "ReusedExchangeExec":
        return []  # counted where it ran
    found = node.children()
    return [found.apply(k) for k in range(found.size())]


def steps(df: DataFrame) -> list[Step]:
    """The operators of a frame that has been run (by ``collect`` or ``toLocalIterator`` on it), parents first.
    Wrappers that do nothing themselves (adaptive plans, stages, codegen) are left out."""
    out: list[Step] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        wraps = node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "WholeStageCodegenExec", "InputAdapter") or node.getClass().getSimpleName().endswith("QueryStageExec")
        if not wraps:
            metrics = node.metrics()
            times = [v for v in (_value(metrics, t) for t in _TIMES) if v is not None]
            out.append(Step(depth, name.strip(), _value(metrics, "numOutputRows"), sum(times) if times else None, _value(metrics, "shuffleBytesWritten")))
        for child in _children(node):
            walk(child, depth + (not wraps))

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return out


def report(df: DataFrame) -> str:
    """``steps`` as text: operator, rows out, milliseconds, bytes shuffled."""

    def field(value: int | None, unit: str) -> str:
        return "" if value is None else f" {value}{unit}"

    return "".join(f"{'  ' * s.depth}{s.operator}:{field(s.rows, ' rows')}{field(s.ms, ' ms')}{field(s.shuffled, ' B shuffled')}\n" for s in steps(df))

"""What a query reads, from the metrics of the plan that ran: the measure of what a layout saves."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Reads:
    """Files, bytes and folders that the scans listed after partition pruning, rows that left the scans (whole row groups are left out by the
    statistics of pushed filters), and rows of the result."""

    files: int = 0
    bytes: int = 0
    folders: int = 0
    rows_read: int = 0
    rows_out: int = 0


def _below(plan) -> list:
    """A physical plan's inputs; adaptive plans and their stages are opened."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [plan.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [plan.plan()]
    if kind == "ReusedExchangeExec":
        return []
    found = plan.children()
    return [found.apply(k) for k in range(found.size())]


def reads(df: DataFrame) -> Reads:
    """Runs df, counts its rows where they are, and adds up what its scans read."""
    run = df._jdf.queryExecution()
    out = Reads(rows_out=run.toRdd().count())
    left = [run.executedPlan()]
    while left:
        plan = left.pop()
        left += _below(plan)
        if "FileSourceScanExec" in plan.getClass().getSimpleName():
            of = plan.metrics()
            value = lambda name: int(of.apply(name).value()) if of.contains(name) else 0  # noqa: B023, E731
            out.files += value("numFiles")
            out.bytes += value("filesSize")
            out.folders += value("numPartitions")
            out.rows_read += value("numOutputRows")
    return out


def compared(spark: SparkSession, forms: dict[str, DataFrame]) -> DataFrame:
    """(form, files, bytes, folders, rows_read, rows_out) of some forms of one question."""
    rows = [(name, *asdict(reads(df)).values()) for name, df in forms.items()]
    return spark.createDataFrame(rows, "form string, files long, bytes long, folders long, rows_read long, rows_out long")

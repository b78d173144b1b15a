"""What a plan reads, what a table holds: explain, estimate, advise, verify."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.filters import where


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def explain(df: DataFrame) -> dict[str, Any]:
    """Pushed and partition filters, columns read, exchanges, joins and code-generation spans of a plan."""
    text = plan_text(df)
    found = lambda key: sorted({x.strip() for m in re.findall(rf"{key}: \[(.*?)\]\n", text) for x in re.split(r", (?![^(]*\))", m) if x.strip()})
    schema = sorted({c.split(":")[0] for m in re.findall(r"ReadSchema: struct<(.*)>", text) for c in re.split(r",(?![^<(]*[>)])", m) if c})
    return {"pushed": found("PushedFilters"), "partitions": found("PartitionFilters"), "columns": schema, "exchanges": len(re.findall(r"^\(\d+\) (?:Broadcast)?Exchange", text, re.M)), "joins": re.findall(r"^\(\d+\) (\w+Join)", text, re.M), "codegen": len(set(re.findall(r"codegen id : (\d+)", text))), "plan": text}


def analyze(df: DataFrame, filter_: Any) -> dict[str, Any]:
    """Run a filter and report rows and milliseconds beside the plan."""
    chosen, began = where(df, filter_), time.perf_counter()
    rows = chosen.count()
    return explain(chosen) | {"rows": rows, "ms": (time.perf_counter() - began) * 1000}


def files(df: DataFrame) -> DataFrame:
    """Rows, least and greatest value of each column for each file, as a DataFrame (a row a file)."""
    orderable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "struct", "map", "variant", "binary")]
    aggs = [a for c in orderable for a in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.sum(F.col(c).isNull().cast("long")).alias(f"nulls_{c}"))]
    return df.withColumn("_file", F.col("_metadata.file_path")).groupBy("_file").agg(F.count(F.lit(1)).alias("rows"), *aggs)


def estimate(df: DataFrame, filter_: dict) -> dict[str, Any]:
    """Files and rows that ranges and equalities of the filter can't rule out."""
    stats = files(df)
    keep = F.lit(True)
    for name, condition in filter_.items():
        if f"min_{name}" not in stats.columns:
            continue
        condition = condition if isinstance(condition, dict) else {"eq": condition}
        for op, v in condition.items():
            low, high = F.col(f"min_{name}"), F.col(f"max_{name}")
            keep &= {"eq": (low <= v) & (high >= v), "gt": high > v, "gte": high >= v, "lt": low < v, "lte": low <= v}.get(op, F.lit(True)) if v is not None else F.lit(True)
    total = stats.agg(F.count(F.lit(1)), F.sum("rows")).first()
    left = stats.where(keep).agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    return {"files": total[0], "rows": total[1] or 0, "candidateFiles": left[0], "candidateRows": left[1]}


def advise(df: DataFrame, columns: list[str]) -> list[dict[str, Any]]:
    """For each column, how many files a value is in on average, over all its values, and whether sorting by it would help."""
    out, n = [], files(df).count()
    for c in columns:
        each = df.select(F.col(f"`{c}`").alias("v"), F.col("_metadata.file_path").alias("f")).where("v is not null").distinct()
        mean = each.groupBy("v").count().agg(F.avg("count")).first()[0] or 0
        out.append({"column": c, "files": n, "filesPerValue": mean, "advice": "sort or partition by it" if n > 1 and mean > max(1.5, 0.25 * n) else "fine"})
    return out


def with_progress(spark: Any, action: Callable[[], Any], on_progress: Callable[[dict[str, int]], None], cancel: threading.Event | None = None, every: float = 0.2) -> Any:
    """Run an action while reporting its tasks, done and in all; setting ``cancel`` ends its jobs with an error."""
    tag, box = f"tabulon-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.setJobGroup(tag, "with progress", True)
        try:
            box["value"] = action()
        except BaseException as e:  # handed on to the caller
            box["error"] = e

    worker, status = InheritableThread(target=run), spark.sparkContext.statusTracker()
    worker.start()
    while worker.is_alive():
        worker.join(every)
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(tag) if (job := status.getJobInfo(j)) for s in job.stageIds]
        on_progress({"tasks": sum(s.numTasks for s in stages if s), "done": sum(s.numCompletedTasks for s in stages if s)})
        if cancel is not None and cancel.is_set():
            spark.sparkContext.cancelJobGroup(tag)
    if "error" in box:
        raise box["error"]
    return box.get("value")

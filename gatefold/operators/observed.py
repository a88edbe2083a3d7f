"""Reports gathered while rows are written: metrics are observed in the pass that writes, so nothing is scanned twice.

The table is written first and judged then; a report below its threshold raises and leaves the table where it is, to be
looked at, unless it is asked to remove it.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gatefold.sources import shared


class BelowThreshold(ValueError):
    """A written table whose report misses its threshold; ``report`` has the figures."""

    def __init__(self, report: dict):
        super().__init__(f"agreement {report['agreement']:.4f} is below {report['threshold']}")
        self.report = report


def written(df: DataFrame, path: str, metrics: dict[str, Column], partition: list[str] | None = None) -> dict:
    """Writes the rows and returns the metrics of the rows written, with ``seconds``. An empty table has the metrics' own
    values for no rows."""
    seen, began = Observation(), time.time()
    out = df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode("overwrite")
    (out.partitionBy(*partition) if partition else out).parquet(path)
    return {**seen.get, "seconds": round(time.time() - began, 3)}


def agreement_metrics(expected: str, observed: str, kinds: dict[str, Column] | None = None) -> dict[str, Column]:
    """cases, checked (observed is known), agreed, and the count of each kind of disagreement."""
    one = {"cases": F.count(F.lit(1)), "checked": F.count(F.col(observed)), "agreed": F.count_if(F.col(expected) == F.col(observed))}
    return one | {name: F.count_if(on) for name, on in (kinds or {}).items()}


def agreement(pairs: DataFrame, path: str, expected: str, observed: str, threshold: float = 0.995, kinds: dict[str, Column] | None = None, dry_run: bool = False, remove: bool = False) -> dict:
    """Writes the pairs and reports on them. Unobserved pairs don't count; without checked ones agreement is 0. Below the
    threshold it raises BelowThreshold, but for a dry run, in which nothing was observed on purpose."""
    got = written(pairs, path, agreement_metrics(expected, observed, kinds))
    report = got | {"agreement": round(got["agreed"] / got["checked"], 5) if got["checked"] else 0.0, "threshold": threshold}
    report["passed"] = dry_run or report["agreement"] >= threshold
    if not report["passed"]:
        if remove:
            shared.remove(pairs.sparkSession, path)
        raise BelowThreshold(report)
    return report


def build(df: DataFrame, path: str, split: str, splits: list[str], size: str) -> dict:
    """Writes a corpus by split and reports on each: rows, the sum and the largest of ``size``; rows of other splits are
    counted as ``other``, so that none goes unnoticed."""
    metrics: dict[str, Column] = {}
    for s in splits:
        own = F.col(split) == s
        metrics |= {f"{s}.n": F.count_if(own), f"{s}.size": F.sum(F.when(own, F.col(size))), f"{s}.max": F.max(F.when(own, F.col(size)))}
    got = written(df, path, metrics | {"other": F.count_if(~F.coalesce(F.col(split).isin(*splits), F.lit(False)))}, [split])
    return {"seconds": got["seconds"], "other": got["other"], "splits": {s: {k: got[f"{s}.{k}"] for k in ("n", "size", "max")} for s in splits}}


def save(spark: SparkSession, report: dict, path: str) -> None:
    """One line of JSON, replaced as a whole."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])

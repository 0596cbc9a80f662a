"""Ask a question of a prepared table: SQL text or a template, then a chart and a summary."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from assayer.operators import charts, findings
from assayer.sources.registry import TableRegistry


@dataclass
class Answer:
    result: DataFrame
    chart: charts.Chart | None
    summary: DataFrame


def ask(registry: TableRegistry, question: str | Callable[..., DataFrame], *args,
        table: str = "dataset", chart: str | None = None, types: Mapping | None = None,
        order_key: Sequence[str] = ()) -> Answer:
    """``question`` is read-only SQL text, or a template function whose arguments follow.

    ``chart`` names a chart kind; row-level kinds read the registered table.
    """
    source = registry.spark.table(table)
    result = registry.query(question) if isinstance(question, str) else question(source, *args)
    return Answer(
        result=result,
        chart=charts.result_chart(result, chart, source=source, types=types, order_key=order_key),
        summary=findings.summarize_result(result),
    )

"""Exports: views, display cells and HTML reports as ordered text rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from html import escape

from pyspark.sql import DataFrame, functions as F

from ..functions.conditions import Condition, apply_conditions
from ..functions.text import html_escape
from ..functions.values import display_cell
from .explore import visible

#: Rows of the short report.


def export_view(
    df: DataFrame, mode: str = "full", conditions: Iterable[Condition] = (), columns: Sequence[str] = ()
) -> DataFrame:
    """What an export holds: everything, the filtered rows, or of those the
    visible columns."""
    if mode == "full":
        return df
    if mode == "filtered":
        return apply_conditions(df, conditions)
    if mode == "visible":
        return visible(apply_conditions(df, conditions), columns)
    raise ValueError(f"Modo desconhecido: {mode!r}; use full, filtered ou visible.")


def display_cells(df: DataFrame) -> DataFrame:
    """All columns as the text a report shows."""
    return df.select(*[display_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    display_cells(df).write.mode("overwrite").csv(path, header=True)


def html_rows(df: DataFrame) -> DataFrame:
    """One escaped table row of markup per row, in column ``html``."""
    cells = [
        F.concat(F.lit("<td>"), html_escape(display_cell(F.col(f"`{f.name}`"), f.dataType)), F.lit("</td>"))
        for f in df.schema.fields
    ]
    return df.withColumn("html", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))


def html_report(
    df: DataFrame,
    title: str,
    cnpj: str,
    table: str,
    order: Sequence[str],
    filters_text: str = "",
    columns: Sequence[str] = (),
    generated_at: datetime | None = None,
) -> DataFrame:
    """A report as text lines, sorted, in column ``value``.

    The number of rows is counted by Spark in the same job, and the body never
    leaves the executors; write the result with ``write.text``.
    """
    at = (generated_at or datetime.now()).strftime("%d/%m/%Y %H:%M:%S")
    facts = {
        "CNPJ": cnpj,
        "Tabela": table,
        "Gerado em": at,
        "Filtros": filters_text or "Sem filtros",
        "Colunas visíveis": ", ".join(columns) if columns else "Todas",
    }
    heading = escape(title)
    listed = "".join(f"<dt>{escape(name)}</dt><dd>{escape(fact)}</dd>" for name, fact in facts.items())
    names = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    top = (
        f'<!DOCTYPE html>\n<html lang="pt-BR">\n<head><meta charset="utf-8"><title>{heading}</title></head>\n'
        f"<body>\n<h1>{heading}</h1>\n<dl>{listed}"
    )
    counted = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("section"),
        F.concat(
            F.lit(f"{top}<dt>Linhas no relatório</dt><dd>"),
            F.col("n").cast("string"),
            F.lit(f"</dd></dl>\n<table>\n<thead><tr>{names}</tr></thead>\n<tbody>"),
        ).alias("value"),
    )
    keys = [f"__key_{i}" for i, _ in enumerate(order)]
    body = html_rows(df).select(
        F.lit(1).alias("section"),
        F.col("html").alias("value"),
        *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys)],
    )
    foot = df.sparkSession.range(1).select(
        F.lit(2).alias("section"), F.lit("</tbody>\n</table>\n</body>\n</html>").alias("value")
    )
    lines = body.unionByName(counted, allowMissingColumns=True).unionByName(foot, allowMissingColumns=True)
    return lines.orderBy("section", *[F.col(k).asc_nulls_last() for k in keys], "value").select("value")


def short_report(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """Cells of the first rows, each with the number of all rows, and whether
    the report leaves some out."""
    total = df.agg(F.count(F.lit(1))).scalar()
    first = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order]).limit(rows)
    return display_cells(first).withColumns({"total_linhas": total, "truncado": total > rows})

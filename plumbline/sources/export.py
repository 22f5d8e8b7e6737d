"""CSV exports of the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Header of each export and the column behind it.
EXPORTS = {
    "pii_map": {
        "coluna_qualificada": "qualified",
        "categoria": "category",
        "confianca": "confidence",
        "metodo": "method",
        "pct_validado": "valid_percent",
        "amostra": "sample_size",
        "contas_leitura": "read_accounts",
        "rls": "has_rls",
        "nivel_acesso": "access_level",
    },
    "cost_ranking": {"tipo": "cost_type", "objeto": "object_key", "bytes": "size_bytes", "valor_mes": "month_amount", "moeda": "currency"},
    "access_matrix": {
        "conta": "account_name",
        "objeto": "object_name",
        "coluna": "column_name",
        "privilegio": "privilege",
        "origem": "origin_kind",
        "destaques": "highlights",
        "decisao": "decision",
    },
    "scenarios": {"hypertable": "hypertable_name", "cenario": "label", "bytes_depois": "bytes_after", "bytes_economizados": "bytes_saved"},
}


def export_rows(rows: DataFrame, report: str) -> DataFrame:
    """Rows under the headers of the report, every value as text."""
    kinds = dict(rows.dtypes)
    columns = []
    for header, name in EXPORTS[report].items():
        value = F.col(name)
        if kinds[name] == "boolean":
            value = F.when(value, "sim").otherwise("nao")
        elif kinds[name].startswith("array"):
            value = F.concat_ws(";", value)
        columns.append(F.coalesce(value.cast("string"), F.lit("")).alias(header))
    return rows.select(*columns)


def export_csv(rows: DataFrame, report: str, path: str) -> None:
    """Write a report as CSV files with a header, one per partition of the rows."""
    export_rows(rows, report).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

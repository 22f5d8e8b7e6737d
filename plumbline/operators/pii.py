"""Discovery of personal data by column name and by content."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.detectors import CONTENT_CATEGORIES, with_validity
from plumbline.functions.text import let, redact

COLUMN = ["environment_id", "run_id", "database_name", "schema_name", "table_name", "column_name"]
SCAN = COLUMN[:2]
TABLE = COLUMN[:5]
MIN_SAMPLE = 50
CONFIDENCES = ("baixa", "media", "alta")

#: Name patterns and their category.
DICTIONARY: tuple[tuple[str, str], ...] = (
    ("cpf", "cpf"),
    ("cpf_numero", "cpf"),
    ("nr_cpf", "cpf"),
    ("tax_id", "cpf"),
    ("cnpj", "cnpj"),
    ("cnpj_numero", "cnpj"),
    ("nr_cnpj", "cnpj"),
    ("email", "email"),
    ("e_mail", "email"),
    ("mail", "email"),
    ("email_address", "email"),
    ("telefone", "telefone"),
    ("celular", "telefone"),
    ("fone", "telefone"),
    ("phone", "telefone"),
    ("mobile", "telefone"),
    ("cep", "cep"),
    ("zipcode", "cep"),
    ("zip_code", "cep"),
    ("pix", "pix"),
    ("chave_pix", "pix"),
    ("pix_key", "pix"),
    ("nome", "nome"),
    ("nome_completo", "nome"),
    ("full_name", "nome"),
    ("nascimento", "nascimento"),
    ("data_nascimento", "nascimento"),
    ("birth_date", "nascimento"),
    ("endereco", "endereco"),
    ("logradouro", "endereco"),
    ("address", "endereco"),
    ("rg", "rg"),
    ("rg_numero", "rg"),
)
# Data types each category may have.
TEXT_TYPES = "char|text|varchar|citext|name|uuid"
NUMBER_TYPES = "int|numeric|decimal|bigint|smallint|double|real"
DATE_TYPES = "date|timestamp|timestamptz"
TYPES_BY_CATEGORY = {
    "cpf": f"{TEXT_TYPES}|{NUMBER_TYPES}",
    "cnpj": f"{TEXT_TYPES}|{NUMBER_TYPES}",
    "rg": f"{TEXT_TYPES}|{NUMBER_TYPES}",
    "cep": f"{TEXT_TYPES}|{NUMBER_TYPES}",
    "telefone": f"{TEXT_TYPES}|{NUMBER_TYPES}",
    "email": TEXT_TYPES,
    "pix": TEXT_TYPES,
    "nome": TEXT_TYPES,
    "endereco": TEXT_TYPES,
    "nascimento": f"{TEXT_TYPES}|{DATE_TYPES}",
}


def normalize_column_name(name: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{Nd}]+", "_"), "^_|_$", "")


def match_category(column_name: Column, dictionary: Sequence[tuple[str, str]] = DICTIONARY) -> Column:
    """Category of a column name, NULL when no pattern fits.

    A whole name or whole word beats a part of a word, then the longer pattern,
    then the earlier entry.  The dictionary is part of the expression, so the
    match needs no join.
    """
    shapes = [(pattern.strip().lower(), category) for pattern, category in dictionary]

    def best(name: Column) -> Column:
        words = F.split(name, "_")

        def scored(tokens: Column) -> Column:
            hits = []
            for position, (shape, category) in enumerate(shapes):
                exact = (name == shape) | F.array_contains(tokens, shape)
                hit = F.struct(
                    exact.cast("int").alias("exact"),
                    F.lit(len(shape)).alias("length"),
                    F.lit(-position).alias("order"),
                    F.lit(category).alias("category"),
                )
                hits.append(F.when(name.contains(shape), hit))
            return F.array_max(F.array(*hits))["category"]

        return F.when(name.rlike("|".join(re.escape(shape) for shape, _ in shapes)), let(words, scored))

    return let(normalize_column_name(column_name), best)


def compatible_type(category: Column, data_type: Column) -> Column:
    """True when a column of this type can hold the category."""
    name = F.lower(data_type)
    fits = F.lit(False)
    for value, pattern in TYPES_BY_CATEGORY.items():
        fits = F.when(category == value, name.rlike(pattern)).otherwise(fits)
    return fits


def classify_metadata(columns: DataFrame, dictionary: Sequence[tuple[str, str]] = DICTIONARY, max_tables: int | None = None) -> DataFrame:
    """Columns whose name tells of personal data, with the confidence their type allows.

    With ``max_tables`` so many tables count as scanned per run; the columns of
    the others stay in the result with ``scanned`` false, which makes the scan partial.
    """
    named = columns.withColumn("category", match_category(F.col("column_name"), dictionary)).where(
        F.col("category").isNotNull()
    )
    confidence = F.when(compatible_type(F.col("category"), F.col("data_type")), "media").otherwise("baixa")
    shown = [*COLUMN, "data_type", "category", confidence.alias("confidence"), F.lit("nome").alias("method")]
    if max_tables is None:
        return named.select(*shown, F.lit(True).alias("scanned"))
    order = W.partitionBy(*SCAN).orderBy("database_name", "schema_name", "table_name")
    taken = (
        named.select(*TABLE)
        .distinct()
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= max_tables)
        .select(*TABLE, F.lit(True).alias("taken"))
    )
    return named.join(taken, TABLE, "left").select(*shown, F.coalesce("taken", F.lit(False)).alias("scanned"))


def detect_content(table: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """Sample size, non-blank and valid values per (column, category) in one pass.

    ``categories`` maps columns of the table to the category to check.
    """
    values = [
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("category"), F.col(c).cast("string").alias("value"))
        for c, k in categories.items()
    ]
    spread = table.select(F.explode(F.array(*values)).alias("v")).select("v.*")
    filled = F.coalesce(F.trim("value") != "", F.lit(False))
    valid = filled & F.col("valid")
    return with_validity(spread, "category", "value").groupBy("column_name", "category").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if(filled).alias("non_null_count"),
        F.count_if(valid).alias("valid_count"),
    )


def valid_percent() -> Column:
    known = F.col("non_null_count")
    return F.when(known > 0, F.col("valid_count") * F.lit(100.0) / known).otherwise(F.lit(0.0))


def sample_confidence() -> Column:
    """``alta`` from 90% valid, ``media`` from 50%, both with 50 values or more."""
    enough = (F.col("sample_size") > 0) & (F.col("non_null_count") >= MIN_SAMPLE)
    return (
        F.when(enough & (valid_percent() >= 90), "alta").when(enough & (valid_percent() >= 50), "media").otherwise("baixa")
    )


def _rank(confidence: Column) -> Column:
    return F.when(confidence == "alta", 3).when(confidence == "media", 2).otherwise(1)


def merge_content(classified: DataFrame, content: DataFrame) -> DataFrame:
    """Name classification joined with the content counts of the same column.

    ``content`` has the column keys, category and the counts of ``detect_content``.
    """
    joined = classified.join(content, [*COLUMN, "category"], "left")
    checked = F.col("sample_size").isNotNull() & F.col("category").isin(*CONTENT_CATEGORIES)
    by_content, by_name = sample_confidence(), F.col("confidence")
    seen = checked & ((by_content != "baixa") | (F.col("valid_count") > 0))
    method = (
        F.when(seen & (by_name == "baixa") & (by_content != "baixa"), "conteudo").when(seen, "ambos").otherwise(F.col("method"))
    )
    merged = F.when(checked & (_rank(by_content) > _rank(by_name)), by_content).otherwise(by_name)
    return joined.select(
        *COLUMN,
        "data_type",
        "category",
        merged.alias("confidence"),
        method.alias("method"),
        "scanned",
        "sample_size",
        "non_null_count",
        "valid_count",
        F.when(checked, valid_percent()).alias("valid_percent"),
    )


def pii_access(results: DataFrame, column_grants: DataFrame, table_grants: DataFrame, roles: DataFrame, rls_tables: DataFrame) -> DataFrame:
    """Who can read each personal-data column, and whether row security guards its table.

    Column grants win over table grants; login roles are kept when any reader is one.  Readers are gathered once for each
    table, not for each of its columns.
    ``column_grants``: column keys, account_name, privilege.  ``table_grants``:
    table keys, grantee, privileges (array).  ``roles``: environment_id, run_id,
    role_name, can_login.  ``rls_tables``: table keys.
    """
    logins = roles.where("can_login").select(*SCAN, F.col("role_name").alias("reader")).distinct().withColumn("login", F.lit(True))

    def readers(grants: DataFrame, keys: list[str], reader: str, name: str) -> DataFrame:
        """The distinct readers of each table or column, each with its login."""
        known = grants.select(*keys, F.col(reader).alias("reader")).join(logins, [*SCAN, "reader"], "left")
        return known.groupBy(*keys).agg(F.collect_set(F.struct("reader", "login")).alias(name))

    by_column = readers(column_grants.where(F.col("privilege").ilike("%SELECT%")), COLUMN, "account_name", "of_column")
    can_read = F.exists("privileges", lambda p: F.upper(p).isin("SELECT", "ALL"))
    by_table = readers(table_grants.where(can_read), TABLE, "grantee", "of_table")
    guarded = rls_tables.select(*TABLE).distinct().withColumn("has_rls", F.lit(True))
    held = F.coalesce("of_column", F.when(F.col("column_name").isNotNull(), F.col("of_table")))
    kept = F.when(F.exists("held", lambda r: r["login"]), F.filter("held", lambda r: r["login"])).otherwise(F.col("held"))
    names = F.array_sort(F.filter(F.transform("kept", lambda r: r["reader"]), lambda x: x.isNotNull()))
    return (
        results.drop("access_level")
        .join(by_column, COLUMN, "left")
        .join(by_table, TABLE, "left")
        .join(guarded, TABLE, "left")
        .withColumn("access_level", F.when(F.col("of_column").isNotNull(), "nivel_coluna").otherwise("nivel_tabela"))
        .withColumn("has_rls", F.coalesce("has_rls", F.lit(False)))
        .withColumn("held", held)
        .withColumn("kept", kept)
        .withColumn("read_accounts", F.when(F.col("kept").isNotNull(), F.size("kept").cast("bigint")).otherwise(0))
        .withColumn("read_names", F.coalesce(names, F.array().cast("array<string>")))
        .drop("of_column", "of_table", "held", "kept")
    )


def latest_scan(scans: DataFrame) -> DataFrame:
    """Latest successful or partly successful scan of every environment."""
    done = scans.where(F.col("status").isin("success", "partial_success"))
    return done.groupBy("environment_id").agg(F.max_by("scan_id", F.struct("started_at", "scan_id")).alias("scan_id"))


def pii_map(results: DataFrame, scans: DataFrame, reviews: DataFrame, category: str = "", confidence: str = "") -> DataFrame:
    """Columns of the latest scan with the review decision, optionally of one category or confidence."""
    kept = results
    if category:
        kept = kept.where(F.col("category") == category)
    if confidence:
        kept = kept.where(F.col("confidence") == confidence)
    column = ["environment_id", *COLUMN[2:]]
    return kept.join(latest_scan(scans), ["environment_id", "scan_id"]).join(
        reviews.select(*column, "decision"), column, "left"
    ).withColumn("review_decision", F.coalesce("decision", F.lit(""))).drop("decision")


def pii_totals(mapped: DataFrame) -> DataFrame:
    """Columns per category."""
    return mapped.groupBy("environment_id", "category").agg(F.count(F.lit(1)).alias("columns"))


def redact_column(table: DataFrame, column: str, target: str | None = None) -> DataFrame:
    """Table with personal data, secrets and numbers of a text column masked."""
    return table.withColumn(target or column, redact(F.col(column)))

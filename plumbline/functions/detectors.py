"""Brazilian personal-data detectors as Column expressions.

Only ASCII digits are read.  Digits are taken by character code, so no cast can
fail on short text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Categories whose content can be checked.
CONTENT_CATEGORIES = ("cpf", "cnpj", "email", "telefone", "cep", "pix")
#: Categories that identify a person or a company directly.
IDENTITY_CATEGORIES = ("cpf", "cnpj", "pix")
# Weights of the check digits.
_CPF_WEIGHTS = (11, 10, 9, 8, 7, 6, 5, 4, 3, 2)
_CNPJ_WEIGHTS = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def company_code(value: Column) -> Column:
    """Upper-case text without the separators of a company number."""
    return F.upper(F.regexp_replace(value, r"[./\-\s]", ""))


def _at(text: Column, position: int) -> Column:
    return F.ascii(F.substring(text, position + 1, 1)) - 48


def _check_digit(text: Column, weights: Sequence[int]) -> Column:
    """Modulo-11 digit: 0 for a rest below 2, else 11 minus the rest."""
    total = reduce(lambda a, b: a + b, [_at(text, i) * w for i, w in enumerate(weights)])
    return (F.lit(11) - total % 11) % 11 % 10


def is_cpf(digits: Column) -> Column:
    """CPF from its digits."""
    return (
        (F.length(digits) == 11)
        & ~digits.rlike(r"^(.)\1*$")
        & (_at(digits, 9) == _check_digit(digits, _CPF_WEIGHTS[1:]))
        & (_at(digits, 10) == _check_digit(digits, _CPF_WEIGHTS))
    )


def is_cnpj(code: Column) -> Column:
    """CNPJ, numeric or alphanumeric, from its ``company_code``."""
    return (
        code.rlike("^[0-9A-Z]{12}[0-9]{2}$")
        & ~code.rlike(r"^([0-9])\1{13}$")
        & (_at(code, 12) == _check_digit(code, _CNPJ_WEIGHTS[1:]))
        & (_at(code, 13) == _check_digit(code, _CNPJ_WEIGHTS))
    )


def is_email(value: Column) -> Column:
    text = F.trim(value)
    return F.octet_length(text).between(5, 254) & text.rlike(
        r"^[\p{L}\p{Nd}._+\-]+@[\p{L}\p{Nd}._+\-]+\.[\p{L}\p{Nd}_+\-]+$"
    )


def is_br_phone(digits: Column) -> Column:
    """Phone from its digits: area code and number, optionally after 55."""
    return digits.rlike("^(?:55)?[1-9][1-9](?:[0-9]{8}|9[0-9]{8})$")


def is_cep(digits: Column) -> Column:
    return F.length(digits) == 8


def is_random_key(value: Column) -> Column:
    return F.lower(F.trim(value)).rlike("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def with_validity(df: DataFrame, category: str, value: str, target: str = "valid") -> DataFrame:
    """Rows with ``target`` telling whether the value is valid for the row's category.

    The digits and each verdict are projected on their own, so a payment key,
    which may be any of the other kinds, does not repeat their expressions.
    """
    kind = F.col(category)

    def only(name: str, verdict: Column) -> Column:
        return F.when(kind.isin(name, "pix"), verdict)

    prepared = df.withColumn("_digits", digits_of(F.col(value))).withColumn("_code", company_code(F.col(value)))
    judged = (
        prepared.withColumn("_cpf", only("cpf", is_cpf(F.col("_digits"))))
        .withColumn("_cnpj", only("cnpj", is_cnpj(F.col("_code"))))
        .withColumn("_email", only("email", is_email(F.col(value))))
        .withColumn("_phone", only("telefone", is_br_phone(F.col("_digits"))))
    )
    verdict = (
        F.when(kind == "cep", is_cep(F.col("_digits")))
        .when(kind == "pix", F.col("_cpf") | F.col("_cnpj") | F.col("_email") | F.col("_phone") | is_random_key(F.col(value)))
        .otherwise(F.coalesce("_cpf", "_cnpj", "_email", "_phone"))
    )
    return judged.withColumn(target, F.coalesce(verdict, F.lit(False))).drop(
        "_digits", "_code", "_cpf", "_cnpj", "_email", "_phone"
    )

"""Masks as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of personal data by parts of column names (compared without underscores and hyphens).
PII_NAMES = {
    "email": "EMAIL_ADDRESS", "phone": "PHONE_NUMBER", "ssn": "US_SSN", "credit_card": "CREDIT_CARD", "name": "PERSON", "first_name": "PERSON", "last_name": "PERSON", "full_name": "PERSON",
    "dob": "DATE_TIME", "birth_date": "DATE_TIME", "ip": "IP_ADDRESS", "address": "LOCATION", "street": "LOCATION", "city": "LOCATION", "zip": "LOCATION", "postal_code": "LOCATION",
    "passport": "US_PASSPORT", "driver_license": "US_DRIVER_LICENSE", "bank_account": "IBAN_CODE", "nationality": "NRP", "gender": "NRP", "religion": "NRP",
}
REDACTED = "[REDACTED]"


def hashed(value: Column, salt: str = "") -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(f"{salt}::"), value).cast("binary"), 256))


def short_hash(value: Column, salt: str = "") -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), value).cast("binary"), 256), 1, 32)


def partial(value: Column) -> Column:
    """The first and last two characters stay; up to four characters, none."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), F.greatest(F.lit(1), n - 4)), F.substring(value, n - 1, F.lit(2))))


def pseudonym(value: Column) -> Column:
    """By kind: mail addresses, numbers, all else."""
    digest = F.md5(value.cast("binary"))
    digits = F.regexp_replace(value, "[+-]", "")
    return (
        F.when(F.contains(value, F.lit("@")), F.concat(F.lit("user"), F.substring(digest, 1, 6), F.lit("@example.com")))
        .when(F.rlike(digits, F.lit("^[0-9]+$")), F.concat(F.lit("+X-XXX-"), F.substring(digest, 1, 4)))
        .otherwise(F.concat(F.lit("[MASKED-"), F.substring(digest, 1, 8), F.lit("]")))
    )


def mask(value: Column, strategy: str, salt: str = "") -> Column:
    """A masked column; nulls stay null. An unknown strategy is an error, never clear text."""
    text = value.cast("string")
    made = {"hash": lambda: hashed(text, salt), "hash32": lambda: short_hash(text, salt), "partial": lambda: partial(text), "redact": lambda: F.lit(REDACTED), "pseudonymize": lambda: pseudonym(text)}.get(strategy)
    if made is None:
        raise ValueError(f"no mask {strategy!r}: hash, hash32, partial, redact, pseudonymize, tokenize or drop")
    return F.when(value.isNotNull(), made())


def apply(df: DataFrame, policy: dict[str, str], salt: str = "") -> DataFrame:
    """C4: ``policy`` gives each column's mask; drop removes it; tokenize joins a random token for each distinct value."""
    for column, strategy in policy.items():
        if strategy == "drop":
            df = df.drop(column)
        elif strategy == "tokenize":
            tokens = df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").cast("string").alias("mask_value")).distinct().withColumn("mask_token", F.concat(F.lit("TOK-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)))
            if df.sparkSession.sparkContext.getCheckpointDir() is not None:
                tokens = tokens.checkpoint()  # random values must not be drawn twice
            df = df.join(tokens, F.col(f"`{column}`").cast("string") == F.col("mask_value"), "left").withColumn(column, F.col("mask_token")).drop("mask_value", "mask_token")
        else:
            df = df.withColumn(column, mask(F.col(f"`{column}`"), strategy, salt))
    return df


def detect(columns: list[str], explicit: list[str] = ()) -> dict[str, str]:
    """Kinds of personal data by name, the longest matching part first. Short parts (up to three letters) must be
    whole words of the name, so that ip is not found in description."""
    out = {}
    for c in columns:
        words = [w.lower() for w in re.split("[_\\W]+|(?<=[a-z])(?=[A-Z])", c) if w]
        flat = "".join(words)
        hits = [k for k in PII_NAMES if (k in words if len(k) <= 3 else k.replace("_", "") in flat)]
        if hits:
            out[c] = PII_NAMES[max(hits, key=len)]
        elif c in explicit:
            out[c] = "UNKNOWN"
    return out

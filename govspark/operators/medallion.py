"""Promotion of raw records to masked Gold, and the check that nothing was left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from govspark import rules
from govspark.functions import detect
from govspark.rules import Detector
from govspark.session import RunFolder
from govspark.sources.gold import GoldStar

# Identifiers get a token and a mask on the way to Silver, so no raw one is stored there.
IDENTIFIER_MASKS = {
    "email": detect.mask_email,
    "phone_number": detect.mask_keep_last,
    "national_id": detect.mask_keep_last,
    "credit_card_number": detect.mask_keep_last,
}
TOKENISED = tuple(IDENTIFIER_MASKS)
# What else tells a person apart is masked on the way to Gold.
PERSONAL_MASKS = {
    "device_ip_address": detect.mask_digits,
    "date_of_birth": lambda c: F.concat(F.left(c.cast("string"), F.lit(4)), F.lit("-##-##")),
    "shipping_address": detect.mask_digits,
    "billing_address": detect.mask_digits,
    "first_name": lambda c: F.concat(F.left(c, F.lit(1)), F.lit("***")),
    "last_name": lambda c: F.concat(F.left(c, F.lit(1)), F.lit("***")),
}
MASKED = {**IDENTIFIER_MASKS, **PERSONAL_MASKS}


def tokenise_columns(df: DataFrame, salt: str, columns=TOKENISED) -> DataFrame:
    """Add ``<column>_token`` for each column that is present.

    ``salt`` is a secret of the caller: with a known one, tokens of short numbers can be undone
    by hashing all of them.
    """
    present = [c for c in columns if c in df.columns]
    return df.withColumns({f"{c}_token": detect.tokenise(F.col(c), salt) for c in present})


def mask_columns(df: DataFrame, masks=None) -> DataFrame:
    """Replace each column that is present by its masked form."""
    masks = MASKED if masks is None else masks
    return df.withColumns({c: f(F.col(c)) for c, f in masks.items() if c in df.columns})


def redact_text(
    df: DataFrame, text: str, detectors: tuple[Detector, ...] = rules.EXTENDED_DETECTORS
) -> DataFrame:
    """Add ``redacted_text`` and the action: MODIFIED where something was replaced."""
    redacted = detect.redact(df, text, "redacted_text", detectors)
    return redacted.withColumn(
        "redact_action",
        F.when(F.col("redacted_text") != F.col(text), F.lit("MODIFIED")).otherwise(F.lit("PASS")),
    )


def to_silver(bronze: DataFrame, salt: str, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """Typed, tokenised and redacted: dates parsed, identifiers replaced by a token and a mask,
    free text redacted.

    Names, addresses, dates of birth and device addresses stay in clear; Gold masks them.
    """
    typed = {}
    if "order_date" in bronze.columns:
        typed["order_date"] = F.col("order_date").cast("timestamp_ntz")
    if "date_of_birth" in bronze.columns:
        typed["date_of_birth"] = F.try_to_date("date_of_birth", "yyyy-MM-dd")
    silver = mask_columns(tokenise_columns(bronze.withColumns(typed) if typed else bronze, salt), IDENTIFIER_MASKS)
    for c in text_columns:
        silver = detect.redact(silver, c, c)
    return silver


def to_gold(silver: DataFrame) -> DataFrame:
    """Masked: nothing personal is left in clear, the tokens stay."""
    return mask_columns(silver, PERSONAL_MASKS)


def promote(
    bronze: DataFrame, silver_path: str, gold_path: str, salt: str, text_columns: tuple[str, ...] = ()
) -> DataFrame:
    """Bronze to Silver to Gold with Parquet in between; returns the Gold table."""
    spark = bronze.sparkSession
    to_silver(bronze, salt, text_columns).write.mode("errorifexists").parquet(silver_path)
    spark.read.parquet(silver_path).transform(to_gold).write.mode("errorifexists").parquet(gold_path)
    return spark.read.parquet(gold_path)


def promote_run(bronze: DataFrame, run: RunFolder, salt: str, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """``promote`` with both layers as steps of a run: started again, it goes on from the layer it has."""
    silver = run.written("silver", lambda: to_silver(bronze, salt, text_columns))
    return run.written("gold", lambda: to_gold(silver))


def promote_star(star: GoldStar, silver_path: str, gold_path: str, salt: str) -> DataFrame:
    """Bronze pieces of Gold to Silver and Gold; returns the Gold table, one row per line.

    Silver is a folder per piece. Tokens and masks are made once per order, customer or part, and
    joined to the lines afterwards. Files are packed with zstd: tokens are hexadecimal digits, which
    take half the room.
    """
    spark = star.lines.sparkSession
    for name, piece in star.pieces().items():
        _packed(to_silver(piece, salt)).parquet(f"{silver_path}/{name}")
    stored = {name: spark.read.parquet(f"{silver_path}/{name}") for name in star.pieces()}
    _packed(GoldStar(**stored).map(to_gold).joined()).parquet(gold_path)
    return spark.read.parquet(gold_path)


def _packed(df: DataFrame) -> DataFrameWriter:
    return df.write.mode("errorifexists").option("compression", "zstd")


def residual_check(
    df: DataFrame, text: str, detectors: tuple[Detector, ...] = rules.EXTENDED_DETECTORS
) -> DataFrame:
    """Redact, then detect again on the result: ``residual_types`` must be empty."""
    return redact_text(df, text, detectors).withColumn(
        "residual_types", detect.detected_types(F.col("redacted_text"), detectors)
    )

"""Client messages and transcription requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import lookup

# How the end of a stream is announced; matched from the start of the message.
EOF_PATTERN = r'^ *\{.*"eof" *: *1.*\} *$'
CONFIG_SCHEMA = "config struct<sample_rate:int,language:string>"


def parse_messages(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``kind`` (config, audio, eof, error), ``sample_rate`` and ``language``; batch or stream.

    A configuration must name a sample rate.
    """
    text = F.col(payload)
    parsed = F.from_json(text, CONFIG_SCHEMA)
    is_config = text.rlike(r'^\s*\{.*"config"')
    return (
        messages.withColumn("__config", F.when(is_config, parsed["config"]))
        .withColumn("sample_rate", F.col("__config.sample_rate"))
        .withColumn("language", F.col("__config.language"))
        .withColumn(
            "kind",
            F.when(text.rlike(EOF_PATTERN), F.lit("eof"))
            .when(is_config & F.col("sample_rate").isNotNull(), F.lit("config"))
            .when(is_config, F.lit("error"))
            .otherwise(F.lit("audio")),
        )
        .drop("__config")
    )


def resolve_requests(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests (request_id, file_name, …) with their file, or an ``error`` each.

    ``files`` has one row per ``file_name``.
    """
    found = files.withColumn("__found", F.lit(True))
    return (
        lookup(requests, found, ["file_name"])
        .withColumn("error", F.when(F.col("__found").isNull(), F.concat(F.lit("File not found: "), F.col("file_name"))))
        .drop("__found")
    )


def response_json(accept: Column, text: Column, language: Column, confidence: Column, words: Column) -> tuple[Column, Column]:
    """The reply body for the accepted type, and an error for any other type."""
    full = F.to_json(
        F.struct(
            text.alias("text"), language.alias("language"), confidence.alias("confidence-score"), words.alias("words")
        )
    )
    body = F.when(accept == "application/json", full).when(accept == "text/plain", text)
    error = F.when(
        ~F.coalesce(accept.isin("application/json", "text/plain"), F.lit(False)), F.lit("Not accepted header")
    )
    return body, error

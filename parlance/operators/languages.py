"""Language names and codes, and lookups that fall back on English."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.fixed import ALIGNMENT_MODELS, LANGUAGES


def language_table(spark: SparkSession) -> DataFrame:
    """Codes and names, each as ``given``; a hundred languages, so broadcasting it is safe."""
    rows = [(code, code) for code in LANGUAGES] + [(name, code) for code, name in LANGUAGES.items()]
    return spark.createDataFrame(rows, "given string, code string")


def resolve_language(rows: DataFrame, language: str = "language", default: str = "*") -> DataFrame:
    """Add ``code`` (null: any language) and ``error`` for what is neither a code nor a name."""
    spelled = F.lower(F.coalesce(F.col(language), F.lit(default)))
    fields = F.split(spelled, "-", -1)
    wanted = rows.withColumn("__given", F.when(F.size(fields) == 2, fields[0]).otherwise(spelled))
    table = F.broadcast(language_table(rows.sparkSession).withColumnRenamed("given", "__given"))
    choices = ", ".join([f"{code}({name})" for code, name in LANGUAGES.items()] + ["*"])
    return (
        wanted.join(table, "__given", "left")
        .withColumn(
            "error",
            F.when(
                F.col("code").isNull() & (F.col("__given") != "*"),
                F.concat(F.lit("Language '"), F.col(language), F.lit(f"' is not available. Available languages are: {choices}")),
            ),
        )
        .drop("__given")
    )


def language_fallback(rows: DataFrame, language: str = "language", force: bool = False) -> DataFrame:
    """Add the alignment ``model`` of the language; without one English is used, or, if forced, an error set."""
    table = F.broadcast(
        rows.sparkSession.createDataFrame(list(ALIGNMENT_MODELS.items()), f"{language} string, model string")
    )
    found = rows.join(table, language, "left")
    missing = F.col("model").isNull() & F.col(language).isNotNull()
    if force:
        return found.withColumn(
            "error", F.when(missing, F.concat(F.lit("No alignment model for language '"), F.col(language), F.lit("'.")))
        )
    return found.withColumn("model", F.when(missing, F.lit(ALIGNMENT_MODELS["en"])).otherwise(F.col("model")))

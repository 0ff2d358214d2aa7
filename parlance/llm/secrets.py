"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every historical version of a file is named by the SHA-256 of its content. A ledger holds which
(blob, rule version) pairs have been scanned. A run scans only the pairs that the ledger lacks,
one text per blob, adds them to the ledger, and joins the findings of all blobs back to every path
and version that holds them. Copies of a text, however many, cost one scan.

Positions come from the pieces between matches: ``split`` gives the pieces, ``regexp_extract_all``
the matches, and a running sum of lengths inside one blob gives start and end in code points.

Defined results: a null text is an empty blob; an empty blob has no findings; repeated rows get the
same findings each; an empty table gives an empty result; other columns of the input are kept by
``mask`` and not looked at otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import stored, table
from parlance.llm.registry import register

RULE_VERSION = 1
INCREMENTS = 2
#: Kind, pattern with group 1 as the part whose length counts, least length.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"(AKIA[A-Z0-9]+)", 16),
    ("hex", r"([0-9a-f]{32,})", 32),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 16),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 16),
)
BASE_KINDS = ("assign", "access", "hex")
#: A whole private key: to its END line, unless 64 hyphens or another BEGIN come first; else the base64 lines that follow.
WHOLE_PEM = (
    r"(-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----BEGIN )[^-]*+){0,64}?-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*+[A-Za-z0-9+/]{16,}+={0,2})*(?:\s++[A-Za-z0-9+/]{1,15}={0,2}(?=\s*(?:\n|$)))?))"
)
#: For masking: the same kinds, with the key behind its header.
MASK_RULES = tuple((k, WHOLE_PEM if k == "pem" else p, n) for k, p, n in RULES)


def blob_of(text: str | Column = "text") -> Column:
    """The content address of a text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unscanned(versions: DataFrame, ledger: DataFrame | None, rule_version: int = RULE_VERSION) -> DataFrame:
    """(blob, text), one row for each blob that ``rule_version`` has not seen.

    Copies are put together in each input task before the shuffle, so that a text that fills a
    third of the table sends one row per task. The ledger is met after that, by the same partitioning.
    """
    texts = versions.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = texts.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is None:
        return blobs
    seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
    # the table of a task is built from the hashes, so texts are not sorted
    return blobs.join(seen.hint("shuffle_hash"), "blob", "left_anti")


def scan(blobs: DataFrame, rule_version: int = RULE_VERSION, rules: tuple = RULES) -> DataFrame:
    """Findings of each blob: (blob, rule_version, kind, ord, start, end)."""

    def of(kind: str, pattern: str, least: int, order: int) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(order).alias("ord"),
            F.arrays_zip(
                F.transform(F.slice(F.split("text", pattern, -1), 1, F.size(found)), lambda p: F.length(p)).alias("gap"),
                F.transform(found, lambda m: F.length(m)).alias("len"),
                F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda m: F.length(m) >= least).alias("counts"),
            ).alias("matches"),
        )

    matched = F.array(*(F.when(F.col("text").rlike(p), of(k, p, n, i)) for i, (k, p, n) in enumerate(rules)))
    # the outer form: the plain one would work out the array a second time for a filter on its size
    hits = blobs.select("blob", F.explode_outer(matched).alias("r")).filter("r is not null")
    single = hits.select("blob", "r.kind", "r.ord", F.posexplode_outer("r.matches").alias("i", "m"))
    upto = Window.partitionBy("blob", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = single.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(upto))
    return ends.filter("m.counts").select(
        "blob", F.lit(rule_version).alias("rule_version"), "kind", "ord",
        (F.col("end") - F.col("m.len")).cast("long").alias("start"), F.col("end").cast("long").alias("end"),
    )


def advance(
    versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rule_version: int = RULE_VERSION,
    rules: tuple = RULES,
) -> tuple[DataFrame, DataFrame]:
    """One increment: the ledger and the findings with all that ``versions`` adds to them.

    ``versions`` has a text column; it may hold all history or only what is new.
    """
    new = unscanned(versions, ledger, rule_version)
    found = stored(scan(new, rule_version, rules), "findings")
    hashes = versions.select(blob_of().alias("blob")).distinct()
    if ledger is not None:
        hashes = hashes.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    entries = hashes.select("blob", F.lit(rule_version).alias("rule_version"))
    return (
        entries if ledger is None else ledger.unionByName(entries),
        found if findings is None else findings.unionByName(found),
    )


def by_increments(
    versions: DataFrame, of: Column, increments: int, rule_version: int = RULE_VERSION, rules: tuple = RULES
) -> tuple[DataFrame, DataFrame]:
    """The ledger and the findings after ``increments`` steps; a version arrives in step ``of``, from 0.

    Every step reads the stored ledger of the steps before it, so a text that came back later is not
    scanned again.
    """
    ledger = findings = None
    for step in range(increments):
        arrived = versions.filter(of.eqNullSafe(F.lit(step)))
        ledger, findings = advance(arrived, ledger, findings, rule_version, rules)
        if step + 1 < increments:
            ledger = stored(ledger, "ledger")
    return ledger, findings


def by_blob(findings: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """(blob, spans): the findings that one version of the rules made in a blob, by start, then kind as listed.

    The list of a blob is bounded by its own text, which is one row of the input.
    """
    return findings.filter(F.col("rule_version") == rule_version).groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("start", "ord", "kind", "end"))).alias("spans")
    )


def located(versions: DataFrame, findings: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """Findings at every path and version: the columns of ``versions`` without text, and spans (null: none)."""
    held = versions.withColumn("blob", blob_of()).drop("text")
    return held.join(by_blob(findings, rule_version), "blob", "left")


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(versions: DataFrame, findings: DataFrame, mark: str = "[SECRET]", rule_version: int = RULE_VERSION) -> DataFrame:
    """``versions`` with every found span replaced by ``mark``; spans that touch share one mark.

    The columns of ``versions`` travel in one struct, so none of their names can clash.
    """
    held = versions.select(blob_of().alias("blob"), F.struct(*versions.columns).alias("row")).join(
        by_blob(findings, rule_version), "blob", "left"
    )
    text = F.col("row.text")

    def step(state: Column, span: Column) -> Column:
        apart = span["start"] > state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(
                apart | (F.size(state["keep"]) == 0),
                F.concat(state["keep"], F.array(F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int")))),
            ).otherwise(state["keep"]).alias("keep"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("keep"))
    cut = F.aggregate(
        "spans", start, step,
        lambda s: F.concat(
            F.array_join(F.transform(s["keep"], lambda k: F.concat(k, F.lit(mark))), ""),
            F.substring(text, (s["at"] + 1).cast("int"), F.length(text)),
        ),
    )
    masked = F.when(F.col("spans").isNull(), text).otherwise(cut)
    return held.select(*(masked.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in versions.columns))


_PIECES = """
  SELECT doc_id, '{kind}' AS kind, {ord} AS ord, p.gap, p.len, p.ok, p.i FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
      'gap': length(s[i]), 'len': length(m[i]), 'ok': length(g[i]) >= {least}, 'i': i}})) AS p
    FROM (SELECT doc_id, regexp_extract_all(text, $re${re}$re$, 0) AS m, regexp_extract_all(text, $re${re}$re$, 1) AS g,
                 regexp_split_to_array(text, $re${re}$re$) AS s
          FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))"""

SQL_OP7 = (
    "WITH found AS ("
    + " UNION ALL ".join(_PIECES.format(kind=k, ord=i, least=n, re=p) for i, (k, p, n) in enumerate(RULES))
    + """), spans AS (
  SELECT doc_id, kind, ord, ok,
         sum(gap + len) OVER (PARTITION BY doc_id, ord ORDER BY i) - len AS s, sum(gap + len) OVER (PARTITION BY doc_id, ord ORDER BY i) AS e
  FROM found),
lists AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord) FILTER (ord < 3), '') AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord) AS spans
  FROM spans WHERE ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN lists USING (doc_id)"""
)


@register("op7_secret_ledger", SQL_OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; each document is one version at its own path.

    The documents arrive in two increments by a hash of the id; the second finds the ledger of the first.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, findings = by_increments(docs, F.pmod(F.xxhash64("doc_id"), F.lit(INCREMENTS)).cast("int"), INCREMENTS)
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,ord:int,kind:string,end:bigint>>)"))
    base = F.filter(spans, lambda s: s["ord"] < len(BASE_KINDS))
    n = lambda i: F.size(F.filter(spans, lambda s: s["ord"] == i)).cast("long")
    return located(docs, findings).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"), _line(spans).alias("spans"),
    )

"""Secret scans by an incremental blob ledger (operator 2).

Every version of a text is addressed by its SHA-256.  The ledger holds, for each blob and
rule version that was scanned, what it found (also when that was nothing).  A scan takes one
row per blob, leaves out the pairs that the ledger holds, runs the other rules, and joins the
findings back to every row that carries the blob.  ``Ledger`` keeps it as a Parquet table: each
update appends the pairs it scanned and scans none of them again; a rule whose version was raised
is scanned anew, and its older findings no longer count.  The query keeps one for its run.

Built-in functions only.  Copies collapse before the shuffle (a partial aggregate); findings
hold one row per blob, so a blob that a third of all rows carry makes one skewed side of a
join, which adaptive execution splits.

Defined cases: a null text is the empty blob; repeated rows each get the blob's findings; an
empty table gives no rows; other columns are ignored; a blob's text is scanned whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.spans import NO_SPANS, find
from sheaf.llm.common import stored, text_or_empty

#: rule -> (version, pattern).  A rule whose pattern changes gets another version.
RULES = {
    "assign": (1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""),
    "access": (1, r"AKIA[A-Z0-9]{16,}+"),
    "hex": (1, r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    "private_key": (1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    "github": (1, r"(?<![A-Za-z0-9_])gh[oprsu]_[A-Za-z0-9]{36,}+"),
}
BASE = ("assign", "access", "hex")
#: A string that every match holds, where there is one; blobs without it skip the pattern.
NEEDS = {"access": "AKIA", "private_key": "PRIVATE KEY-----", "github": "gh"}
SHORTEST_VALUE = 6  # characters of an assigned value

LEDGER_SCHEMA = f"blob binary, rule_version string, spans {NO_SPANS}"


def rule_version(rule: str) -> str:
    return f"{rule}@{RULES[rule][0]}"


def _spans(text: Column, rule: str) -> Column:
    spans = find(text, RULES[rule][1])
    if rule == "assign":  # the value is the run of its characters at the end, behind the separator
        value = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
        spans = F.filter(spans, lambda s: F.length(F.regexp_replace(s["text"], value, "")) >= SHORTEST_VALUE)
    if rule in NEEDS:
        spans = F.when(F.contains(text, F.lit(NEEDS[rule])), spans).otherwise(F.array().cast(NO_SPANS))
    return spans


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, text of every row."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows for ``versions`` (blob, text): the pairs that ``ledger`` lacks, as one row per blob
    with an array of (rule_version, spans)."""
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(rule_version(r)) for r in RULES])
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.filter(F.size("todo") > 0)
    text = F.col("text")
    new = [F.when(F.array_contains("todo", rule_version(r)), F.struct(F.lit(rule_version(r)).alias("rule_version"), _spans(text, r).alias("spans"))) for r in RULES]
    return todo.select("blob", F.array_compact(F.array(*new)).alias("found"))


def as_ledger(scanned: DataFrame) -> DataFrame:
    """One row per blob and rule version, as the ledger keeps them."""
    return scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.rule_version", "f.spans")


def _in_order(found: Column, rules: tuple[str, ...]) -> Column:
    """kind:start:end by start, then by the rule's place in the list."""

    def ranked(place: int, rule: str) -> Column:
        own = F.flatten(F.transform(F.filter(found, lambda f: f["rule_version"] == rule_version(rule)), lambda f: f["spans"]))
        return F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.concat_ws(":", F.lit(rule), s["start"], s["end"]).alias("said")))

    every = F.concat(*[ranked(i, r) for i, r in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(every), lambda x: x["said"]), ",")


class Ledger:
    """The ledger as a table at ``path``, which all executors must reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def parts(self) -> list[str]:
        """The folders of the updates that were finished, oldest first."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(top) if x.isDirectory())
        return [f"{self.path}/{n}" for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def rows(self) -> DataFrame:
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*parts)

    def update(self, versions: DataFrame) -> int:
        """Scans what ``versions`` (blob, text) hold and the ledger lacks, and appends it; the number of pairs scanned."""
        known = self.parts()
        found = as_ledger(scan(versions, self.rows() if known else None))
        new = f"{self.path}/update-{len(known):06d}-{uuid.uuid4().hex}"
        found.write.parquet(new)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(new).count()


def digest(docs: DataFrame, ledger: Ledger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: counts of the base rules and all spans; what the ledger lacks is scanned and added to it first."""
    versions = addressed(docs, id_col, text_col)
    ledger.update(versions.select("blob", "text"))
    found = ledger.rows().filter(F.col("rule_version").isin([rule_version(r) for r in RULES]) & (F.size("spans") > 0))
    found = found.groupBy("blob").agg(F.collect_list(F.struct("rule_version", "spans")).alias("found"))  # at most one row a rule

    def count(rule: str) -> Column:
        own = F.filter("found", lambda f: f["rule_version"] == rule_version(rule))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, f: acc + F.size(f["spans"]))

    told = found.select(  # written out, so that the join below has a plain table on either side and hot blobs can be split
        "blob",
        *[count(r).alias(f"n_{r}") for r in BASE],
        F.sha2(_in_order(F.col("found"), BASE), 256).alias("base_sha256"),
        _in_order(F.col("found"), tuple(RULES)).alias("spans"),
    )
    told = stored(told, "findings")
    return versions.select("doc_id", "blob").join(told, "blob", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{r}", F.lit(0).cast("long")).alias(f"n_{r}") for r in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.lower(F.hex("blob")).alias("blob_sha256"),
    )

"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). A ledger table says which pairs of
(blob, rule version) have been scanned and what was found; a run scans only pairs that the ledger does not
have, each blob once however many paths hold it, and joins the findings back to all paths.

Addresses alone decide what is unseen and which path speaks for a blob; only the texts of those paths are then looked
up and scanned. Joining back, blobs that hold a thousandth of all paths come by broadcast, so none is a hot key. The
ledger is a Parquet table; ``run`` appends to it. Rows that a retried run appends again are harmless: a pair counts once.
Spans are in code points, end exclusive; base spans are the leftmost non-overlapping matches of each kind.

Defined cases: a null text counts as empty; an empty text has no finding but is entered in the ledger; equal
texts share one ledger row; a null path is a path; repeated rows are one; a very long text is scanned whole, alone; an
empty table gives an empty ledger; extra columns are ignored by the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut_lineage, with_facts

# The rules of the base scan, in the order in which kinds are listed.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", re.A, 0, 16),
    ("hex", r"[0-9a-f]+", re.A, 0, 32),
)
RULE_VERSION = "base-1"
LEDGER = "blob string, rule_version string, findings array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts, and the least length of that group."""

    kind: str
    pattern: str
    flags: int
    group: int
    least: int

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)


BASE_RULES = tuple(Rule(*r) for r in RULES)

#: What a text must hold for a rule to match at all; found much faster than the rule itself.
_NEEDS = {"assign": re.compile("[:=]"), "access": re.compile("AKIA"), "hex": re.compile("(?<![0-9a-f])[0-9a-f]{32}")}


def find_spans(text: str, rules: tuple[Rule, ...] = BASE_RULES) -> list[tuple[str, int, int]]:
    """All spans of one text by start, then by the order of the rules."""
    found = []
    for order, rule in enumerate(rules):
        if rule in BASE_RULES and not _NEEDS[rule.kind].search(text):
            continue
        for m in rule.compiled().finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def addressed(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the content address of every version."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def unseen(versions: DataFrame, ledger: DataFrame | None, rule_version: str, path_col: str = "doc_id") -> DataFrame:
    """(blob, _at) for every blob of addressed versions that the ledger lacks under this rule version; _at is the hash of the path that speaks for it."""
    blobs = versions.select("blob", F.xxhash64(path_col).alias("_at"))
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(known.hint("merge"), "blob", "left_anti")
    return blobs.groupBy("blob").agg(F.min("_at").alias("_at"))


def scan(blobs: DataFrame, rule_version: str = RULE_VERSION, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Ledger rows for blobs (blob, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, rules)] for t in b["text"]]
            yield pd.DataFrame({"blob": b["blob"], "rule_version": rule_version, "findings": found})

    return blobs.mapInPandas(run, LEDGER)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text", path_col: str = "doc_id") -> DataFrame:
    """The rows that this run adds to the ledger; append them to its table."""
    rows = addressed(versions.select(path_col, text_col), text_col)
    new = cut_lineage(unseen(rows, ledger, rule_version, path_col))
    if new.isEmpty():
        return versions.sparkSession.createDataFrame([], LEDGER)
    texts = rows.select("blob", F.xxhash64(path_col).alias("_at"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = texts.join(new.hint("merge"), ["_at", "blob"], "left_semi").dropDuplicates(["_at", "blob"])  # rows that repeat a path and its text
    return scan(one.select("blob", "text"), rule_version, rules)


def run(versions: DataFrame, path: str, rule_version: str = RULE_VERSION, rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text", path_col: str = "doc_id") -> DataFrame:
    """Append what versions add to the ledger table at path (made if it isn't there) and return it."""
    spark = versions.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
    read = spark.read.schema(LEDGER)
    update_ledger(versions, read.parquet(path) if there else None, rule_version, rules, text_col, path_col).write.mode("append").parquet(path)
    return read.parquet(path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, text_col: str = "text", path_col: str = "doc_id") -> DataFrame:
    """Every version's own columns (less its text) with its blob and the findings of it."""
    kept = [c for c in versions.columns if c not in (text_col, "blob", "findings", "rule_version")]
    paths = cut_lineage(addressed(versions, text_col).select(*kept, "blob"))
    found = ledger.filter(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("findings").alias("findings"))
    copies = paths.groupBy("blob").agg(F.count("*").alias("copies"))
    return with_facts(paths, cut_lineage(copies.join(found, "blob")), "blob", paths.count(), path_col)


def digest_spans(findings: DataFrame) -> DataFrame:
    """Counts by kind and the listed spans of findings_by_path()."""
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return findings.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), "blob")


def secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Scan what is unseen, then report on all documents."""
    versions = docs.select("doc_id", "text")
    new = cut_lineage(update_ledger(versions, ledger))
    return digest_spans(findings_by_path(versions, new if ledger is None else ledger.unionByName(new)))


def secrets_by_ledger(docs: DataFrame, path: str) -> DataFrame:
    """Enter in the ledger table at path what documents add to it, and report on all documents from the table."""
    versions = docs.select("doc_id", "text")
    return digest_spans(findings_by_path(versions, run(versions, path)))

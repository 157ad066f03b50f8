"""Secret scans over all versions of all files, with a ledger of what was scanned.

A version's content is addressed by its SHA-256. The ledger holds, per content, which versions of which rules have
seen it and what they found. A scan takes distinct contents only, leaves out every pair of content and rule version that
the ledger has, and appends what it did. Findings come from the ledger, joined back to every path and version
with that content. A new rule, or a new version of one, scans old contents for that rule only.

Ledger rows are whole (a content, the rules that saw all of it, all they found), so rows left by a job that failed
halfway are right, and the next scan goes on with the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.llm import shared

LEDGER = "blob string, rules array<string>, found array<struct<rule: string, start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches that don't overlap, dropped if `group` is shorter than `least`."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.compile(self.pattern).finditer(text) if len(m[self.group]) >= self.least]


def either_case(words: str) -> str:
    """A pattern that takes its ASCII letters in either case, and nothing else for them."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


# The base rules.
BASE = (
    Rule("assign", either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Further rules: key blocks, tokens with a known head, signed tokens, and credentials in addresses.
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}"),
    Rule("login", r"://[A-Za-z0-9._~%-]{1,128}:[A-Za-z0-9._~%!$&*+=-]{3,128}@[A-Za-z0-9]"),
)


def address(text: str | Column) -> Column:
    """The content address; NULL is an empty content."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path`, which is made where there is none."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(blob, text, due): each content once, with the rule versions that have not seen it. Copies are reduced before they are shuffled."""
    blobs = versions.select(address(text).alias("blob"), F.coalesce(text, F.lit("")).alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("_seen"))
    due = F.array_except(F.array(*[F.lit(r.name) for r in rules]), F.coalesce("_seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", due.alias("due")).filter(F.size("due") > 0)


def scanned(due: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for (blob, text, due)."""
    by_name = {r.name: r for r in rules}
    kinds = pa.schema([("blob", pa.string()), ("rules", pa.list_(pa.string())), ("found", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob, text, names in zip(*(batch.column(c) for c in ("blob", "text", "due"))):
                content, names = text.as_py(), names.as_py()
                found = [{"rule": n, "start": a, "end": b} for n in names for a, b in by_name[n].spans(content)]
                rows.append({"blob": blob.as_py(), "rules": names, "found": found})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return due.mapInArrow(scan, LEDGER)


def scan(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scans what the ledger at `path` lacks, appends it, and returns the ledger.

    `versions` holds any number of versions of any paths; NULL texts count as empty, copies and repeated rows are one content,
    and other columns don't matter."""
    spark = versions.sparkSession
    scanned(unseen(versions, opened(spark, path), rules, text), rules).write.mode("append").parquet(path)
    return opened(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All rows and columns of `versions`, with `blob` and `spans` (kind, start, end; by start, then in the order of `rules`).

    Spans are code points, the end exclusive. Only what the given rule versions found counts. A version whose content the ledger lacks has
    NULL spans, one without a finding none. Columns named like the added ones are replaced."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.struct(F.lit(i).alias("i"), F.lit(r.kind).alias("kind")))])
    rule = lambda f: order[f["rule"]]
    current = F.filter(F.flatten(F.collect_list("found")), lambda f: rule(f).isNotNull())
    placed = F.array_distinct(F.array_sort(F.transform(current, lambda f: F.struct(f["start"].alias("start"), rule(f)["i"].alias("i"), rule(f)["kind"].alias("kind"), f["end"].alias("end")))))
    spans = F.transform(placed, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    # written, so that the join shuffles both sides and can split a content that a large share of the versions has
    known = shared.stored(ledger.groupBy("blob").agg(spans.alias("spans")))
    return versions.drop("blob", "spans").withColumn("blob", address(text)).join(known, "blob", "left").select(*[c for c in versions.columns if c not in ("blob", "spans")], "blob", "spans")


def shown(spans: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (SHA-256 of its UTF-8 bytes). The
ledger holds the pairs (blob, rule version) that have been scanned and what was
found in them. A scan of new versions reads only the texts of pairs that the
ledger lacks, one text per blob, and joins the findings back to all paths
(documents) that hold the blob. A rule set's version is a digest of its rules,
so a changed rule set scans every blob anew and an unchanged one scans nothing.
``extended`` stores what a batch of versions adds to a ledger; the query takes its
table as a history of ``batches`` parts, scans each against the ledger of those before,
and reports all paths from the stored ledger alone. A ledger may be read from any table
with its columns; pairs that it holds twice count once.

Before a text is moved or handed to Python, one JVM regular expression decides
whether any rule can match at all; most texts end there, in the ledger as clean.
That test is implied by every rule, so it drops no finding.

Rules of the base kinds (assign, access, hex) are given by contract; more kinds
add spans. Positions are code points, the end is exclusive. Spans are ordered by
start, then by kind in the order of the rules.

Defined results: null text counts as empty and has no findings; copies share one
scan; repeated rows and null ids each keep their row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import filled_text, private, saved


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    hint: str  #: Java regex that matches wherever pattern does
    flags: int = re.ASCII
    group: int = 0
    least: int = 0  #: characters that the group must have
    base: bool = False


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "(?i:passw|secret|token|api_?key)", re.ASCII | re.IGNORECASE, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", "AKIA", re.ASCII, 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", "[0-9a-f]{24}", re.ASCII, 0, 24, True),  # a run of 24 or more is the whole run
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\s+[A-Za-z0-9+/=]{16,76})*(?:\s+[A-Za-z0-9+/=]{1,76}\s+-----END [A-Z ]{0,20}PRIVATE KEY-----)?", "PRIVATE KEY-----"),
    Rule("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b", "gh[pousr]_"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "eyJ"),
    Rule("bearer", r"\b[Bb]earer [A-Za-z0-9._~+/-]{20,}=*", "[Bb]earer "),
)
RULES = BASE_RULES + MORE_RULES
#: A private key up to its END line if one follows, whatever its body looks like; else the headers and runs of base64 that stand there. SQL's patterns can't express it, so RULES keeps the shorter one.
WHOLE_PEM = Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)", "PRIVATE KEY-----")
WHOLE_RULES = tuple(WHOLE_PEM if r.kind == "pem" else r for r in RULES)


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


class Scanner:
    """Finds (start, order of the kind, end) of every rule in a text."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(r, re.compile(r.pattern, r.flags)) for r in rules]

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        for k, (rule, pattern) in enumerate(self.rules):
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return sorted(found)


FINDINGS = "array<struct<start: int, kind: int, stop: int>>"
LEDGER = f"blob binary, version string, found {FINDINGS}"


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _addressed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("path"), F.unhex(F.sha2(filled_text().cast("binary"), 256)).alias("blob"))


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of the (blob, rule version) pairs in docs that ledger lacks."""
    version = rules_version(rules)
    text = filled_text()
    suspect = text.rlike("|".join(r.hint for r in rules))
    blobs = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), F.when(suspect, text).alias("text"))

    def scan(batches):
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            found = [[{"start": s, "kind": k, "stop": e} for s, k, e in scanner(t)] if t is not None else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array([version] * b.num_rows), pa.array(found, kind)], ["blob", "version", "found"])

    # Clean blobs need no text; suspect ones are few, and one of their copies is scanned.
    clean = blobs.where("text IS NULL").select("blob").distinct()
    dirty = blobs.where("text IS NOT NULL")
    if ledger is not None:
        seen = ledger.where(F.col("version") == version).select("blob")
        clean, dirty = clean.join(seen, "blob", "left_anti"), dirty.join(seen, "blob", "left_anti")
    dirty = dirty.dropDuplicates(["blob"])
    none = clean.select("blob", F.lit(version).alias("version"), F.expr(f"CAST(array() AS {FINDINGS})").alias("found"))
    return dirty.mapInArrow(scan, LEDGER).unionByName(none)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found) of every row of docs, from a ledger that knows its blobs."""
    known = ledger.where((F.col("version") == rules_version(rules)) & (F.size("found") > 0)).dropDuplicates(["blob"]).select(F.col("blob").alias("__blob"), "found")
    # Only blobs with findings are joined; a hot one is split by adaptive execution.
    at = _addressed(docs)
    return at.join(known, F.col("blob") == F.col("__blob"), "left").select("path", "blob", F.coalesce("found", F.expr(f"CAST(array() AS {FINDINGS})")).alias("found"))


def extended(ledger: DataFrame, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """ledger with the pairs of docs that it lacked, stored."""
    return ledger.unionByName(saved(scan_new(docs, ledger, rules)))


def ledger_of(docs: DataFrame, rules: tuple[Rule, ...] = RULES, batches: int = 2) -> DataFrame:
    """The ledger after docs came in batches; a hash of the path picks a row's batch."""
    ledger = empty_ledger(docs.sparkSession)
    for k in range(batches):
        ledger = extended(ledger, docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), rules)
    return ledger


def secret_report(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, batches: int = 2) -> DataFrame:
    """Counts, digest and spans of every document, by a ledger of its own history or by one that is extended."""
    book = ledger_of(docs, rules, batches) if ledger is None else extended(ledger, docs, rules)
    found = findings(docs, book, rules)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["stop"])), ",")
    of_kind = lambda k: lambda s: s["kind"] == k
    base = [k for k, r in enumerate(rules) if r.base]
    counts = [F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    return found.select(
        F.col("path").alias("doc_id"),
        *counts,
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.hex("blob").alias("blob"),
    )


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of text replaced by ``[kind]``.

    Overlapping spans merge under the kind of the first. Texts that no rule can
    match don't move and are passed on as they are, null included; the others
    meet their blob's findings in the ledger's fresh and old rows. n_chars, if there,
    follows.
    """
    columns = docs.columns
    blob, known_blob, found = private(docs, "blob", "known_blob", "found")
    book = scan_new(docs, ledger, rules)
    if ledger is not None:
        book = book.unionByName(ledger.where(F.col("version") == rules_version(rules)))
    book = book.where(F.size("found") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias(known_blob), F.col("found").alias(found))
    suspect = F.coalesce(F.col("text").rlike("|".join(r.hint for r in rules)), F.lit(False))
    moved = docs.where(suspect).withColumn(blob, F.unhex(F.sha2(filled_text().cast("binary"), 256)))
    moved = moved.join(book, F.col(blob) == F.col(known_blob), "left").drop(blob, known_blob)

    def cut(batches):
        for b in batches:
            at, out = b.schema.get_field_index("text"), []
            for t, spans in zip(b.column(at).to_pylist(), b.column(found).to_pylist(), strict=True):
                parts, done = [], 0
                for s in spans or ():
                    if s["start"] >= done:
                        parts += [t[done : s["start"]], f"[{rules[s['kind']].kind}]"]
                    done = max(done, s["stop"])
                out.append("".join([*parts, t[done:]]))
            b = b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))
            yield b.select([c for c in b.schema.names if c != found])

    changed = moved.mapInArrow(cut, docs.schema)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(~suspect).unionByName(changed).select(*(F.col(f"`{c}`") for c in columns))

"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text (a
blob).  The ledger is a Parquet table of scanned (blob, rules) pairs, the
findings another.  A scan takes the blobs that the ledger lacks for the current
rules, keeps one text of each, finds the spans, appends both tables and joins
the findings of all blobs back to all paths.  A changed rule changes the rules'
version, so only then are known blobs scanned again.

A blob's text travels at most once from each task to its scanner: copies are
folded before the shuffle, so a blob that fills a third of the table is a few rows.

Rules: ``assign``, ``access`` and ``hex`` as given; further ones are
``private_key`` blocks, ``github`` tokens, ``jwt`` and ``url_password``; no part of
theirs has a greatest length.

Defined results: a null text is the empty blob; empty texts have no finding;
repeated rows, and equal texts under other ids, get the same findings; null
path ids are kept; extra columns are ignored; empty tables give empty results.
Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from voicegrid.llm.shared_files import new_folder
from voicegrid.llm.text_arrays import column_of, in_chunks
from voicegrid.session import scratch_table

FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, and its least length.

    ``search`` stands for the pattern in time linear in the text: where it leaves the group empty there is no match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    search: str = ""


def _letters(word: str) -> str:
    """A pattern for ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(map(_letters, ("password", "passwd", "secret", "token"))) + "|" + _letters("api") + "_?" + _letters("key")
_JWT, _USER = "[A-Za-z0-9_-]", r"[^\x00-\x20:/@]"
#: In the order in which spans with one start are listed.
RULES = (
    Rule("assign", rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:-?[A-Za-z0-9+/=\r\n\x20:,])*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    # Each run of a part's characters is taken whole: its end is no character of it, and no part can begin anew inside it.
    Rule("jwt", rf"eyJ{_JWT}+\.eyJ{_JWT}+(\.{_JWT}+)", 1, 1, rf"eyJ{_JWT}++(?:\.eyJ{_JWT}++(\.{_JWT}++)|)"),
    Rule("url_password", rf"://{_USER}+:({_USER}+)@", 1, 3, rf"://{_USER}++(?::({_USER}++)@|)"),
)
BASE = ("assign", "access", "hex")


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: str, compiled: list[tuple[Rule, re.Pattern]]) -> list[dict]:
    """Leftmost non-overlapping matches of each rule that are long enough, by start, then rule."""
    out = []
    for order, (rule, pattern) in enumerate(compiled):
        for match in pattern.finditer(text):
            if match.end(rule.group) - match.start(rule.group) >= rule.least:
                out.append((match.start(), order, match.end(), rule.kind))
    return [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(out)]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, re.Pattern]]:
    # Runs shorter than the least length can't pass, so a hex rule may skip them at once.
    return [(rule, re.compile((rule.search or rule.pattern).replace("[0-9a-f]+", "[0-9a-f]{%d,}" % rule.least))) for rule in rules]


class Ledger:
    """The two tables of a ledger folder in the shared store."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or new_folder(spark, "ledger")

    def _read(self, name: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.folder}/{name}")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def findings(self) -> DataFrame:
        """One row for each scanned pair: the ledger and its findings are written together, so none lacks the other."""
        return self._read("scans", f"blob binary, rules string, found {FINDINGS}")

    def append(self, scans: DataFrame) -> None:
        scans.write.mode("append").parquet(f"{self.folder}/scans")


def scan_unseen(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...], text_col: str) -> None:
    """Scans the blobs of ``versions`` that the ledger lacks for these rules."""
    version = rules_version(rules)
    seen = ledger.findings().where(F.col("rules") == version).select("blob")
    blobs = versions.select(_blob(text_col).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text"))
    unseen = blobs.join(seen, "blob", "left_anti").groupBy("blob").agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_rules(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in in_chunks(batches, "text"):
            found = [find_spans(text, compiled) for text in column_of(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(batch, "blob"), pa.array(found, kind)], ["blob", "found"])

    scans = unseen.mapInArrow(run, f"blob binary, found {FINDINGS}")
    ledger.append(scans.select("blob", F.lit(version).alias("rules"), "found"))


def _blob(text_col: str):
    return F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256))


def scan_history(
    versions: DataFrame, ledger: Ledger, *, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """The path columns of every version with its ``blob`` and ``found`` spans, after scanning what is new."""
    scan_unseen(versions, ledger, rules, text_col)
    version = rules_version(rules)
    scans = _known_findings(ledger, version)
    paths = versions.select(*path_cols, _blob(text_col).alias("blob"))
    return paths.join(scans, "blob", "left").select(
        *path_cols, "blob", F.coalesce("found", F.array().cast(FINDINGS)).alias("found")
    )


def _known_findings(ledger: Ledger, version: str) -> DataFrame:
    """One stored row for each blob with findings.

    Two runs at one time may both scan a blob; their findings are equal.  The
    rows are stored, so that adaptive execution may split a blob that fills the
    table when it is joined.
    """
    scans = ledger.findings().where((F.col("rules") == version) & (F.size("found") > 0)).dropDuplicates(["blob"])
    return scratch_table(scans.select("blob", "found"), "findings")


def redact(
    docs: DataFrame, ledger: Ledger, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``docs`` with each finding replaced by ``[kind]``; of overlapping findings the first leaves its mark.

    The rows keep their columns; a null text stays null.
    """
    scan_unseen(docs, ledger, rules, text_col)
    here = f"_found_{uuid.uuid4().hex}"
    found = _known_findings(ledger, rules_version(rules)).withColumnRenamed("found", here)
    columns = docs.columns
    rows = docs.join(found, _blob(docs[text_col]) == found["blob"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, text_col):
            at = batch.schema.names.index(text_col)
            both = zip(batch.column(at).to_pylist(), column_of(batch, here).to_pylist())
            texts = pa.array([_masked(text, spans) if spans else text for text, spans in both], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts).select(columns)

    return rows.select(*[docs[c] for c in columns], here).mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[dict]) -> str:
    out, done = [], 0
    for span in spans:
        if span["start"] >= done:
            out += [text[done : span["start"]], f"[{span['kind']}]"]
        done = max(done, span["end"])
    return "".join([*out, text[done:]])

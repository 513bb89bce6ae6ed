"""Secret scans with an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its text (a blob). The ledger
has a row for each scan of a blob: which rules ran, and what they found. A scan looks
for (blob, rule, version) triples that the ledger lacks, reads each such blob once,
however many paths and versions have it, and the findings are joined back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_or_empty
from .spans import Span, digest, joined


@dataclass(frozen=True)
class Rule:
    """`group` (0: the whole match) must have `least` characters or the match is dropped, with no second try; `at` is the group that the span covers."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    at: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # of runs taken whole, those of 32 or more
)
#: Kinds beyond the base ones. A jwt is looked for from the start of each run of its characters, once, so that a text costs time linear in its length.
MORE = (Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)", at=1))
RULES = (*BASE, *MORE)
#: Unseen blobs up to this number (8 MB of addresses) are looked up without shuffling the versions.
FEW = 1 << 18
#: Parts of the versions of a blob in a join.
SALTS = 16
LEDGER_SCHEMA = "blob binary, rules array<string>, found array<struct<kind:string,start:int,end:int>>"


def scan(text: str, rules: tuple[Rule, ...]) -> list[Span]:
    return [(r.kind, *m.span(r.at)) for r in rules for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]


def blob_of(text_col: str):
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows: each distinct blob of versions with the (rule, version) pairs the ledger lacks for it.

    Null text is the empty blob. Copies are combined before the shuffle, so a blob
    that a third of the rows share costs one row for each map task. An empty table,
    or one that the ledger covers, gives an empty one; other columns are not read.
    """
    addressed = versions.select(blob_of(text_col).alias("blob"), text_or_empty(text_col).alias("text"))
    wanted = F.array(*(F.lit(r.name) for r in rules))
    once = lambda of: of.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        todo = once(addressed).withColumn("rules", wanted)
    else:
        # what is unseen is known by addresses alone; texts that the ledger covers aren't shuffled if the rest is small
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        new = addressed.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
        new = settle(new.filter(F.size("rules") > 0))
        few = new.count() <= FEW
        todo = once(addressed.join(F.broadcast(new.select("blob")) if few else new.select("blob"), "blob", "left_semi")).join(new, "blob")
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, tuple(by_name[n] for n in names))] for t, names in zip(b["text"], b["rules"])]
            yield pd.DataFrame({"blob": b["blob"], "rules": b["rules"], "found": found})

    return todo.mapInPandas(run, LEDGER_SCHEMA)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, blob, found): each row of versions with the findings of these rules' versions, an empty array if none.

    Only blobs with findings are joined; rows keep their number, repeated ones too.
    """
    kinds = {r.kind for r in rules}
    names = F.array(*(F.lit(r.name) for r in rules))
    hits = (
        ledger.filter(F.arrays_overlap("rules", names) & (F.size("found") > 0))
        .select("blob", F.explode("found").alias("f"), "rules")
        .filter(F.col("f.kind").isin(*kinds))
        .filter(F.exists("rules", lambda r: r.isin(*[r.name for r in rules]) & (F.substring_index(r, "@", 1) == F.col("f.kind"))))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set("f")).alias("found"))
    )
    paths = versions.select(F.col(path_col).alias("path"), blob_of(text_col).alias("blob"), F.pmod(F.xxhash64(path_col), F.lit(SALTS)).cast("int").alias("salt"))
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return paths.join(hits, ["blob", "salt"], "left").select("path", "blob", F.coalesce("found", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("found"))


def span_digests(found: DataFrame) -> DataFrame:
    """The digest columns of (path, found)."""
    base, kinds = {r.kind for r in BASE}, tuple(r.kind for r in RULES)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, found in zip(b["path"].astype("Int64"), b["found"]):
                spans = [(f["kind"], f["start"], f["end"]) for f in found]
                own = [s for s in spans if s[0] in base]
                rows.append((path, *(sum(s[0] == r.kind for s in own) for r in BASE), digest(joined(own, kinds)), joined(spans, kinds)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    return found.select("path", "found").mapInPandas(run, schema)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[DataFrame, int]:
    """(the ledger with what versions add to it, settled; the number of blobs that were scanned)."""
    new = settle(scan_unseen(versions, ledger, rules, text_col))
    return new if ledger is None else ledger.unionByName(new), new.count()


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_scanned_again), one row for each row of docs (doc_id, text).

    The documents are scanned into an empty ledger; then they come a second time, as the
    next commit that leaves them as they are, and n_scanned_again tells how many blobs that scans: none.
    Null text counts as empty and has no spans. Rows with a null identifier and repeated rows
    stay; equal texts have equal findings; an empty table gives an empty one; other columns are not read.
    """
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    ledger, _ = update_ledger(versions)
    ledger, again = update_ledger(versions, ledger)
    return span_digests(findings_by_path(versions, ledger)).withColumn("n_scanned_again", F.lit(again).cast("long"))

"""Secret scans separated by corpus-wide ownership frequency.

Each text is scanned once for assignments, access keys and hex runs, and for
other tokens that look random.  Hashes of all candidate values are then counted
over the whole corpus by distinct repositories and by distinct owners of those:
a value that few owners hold, in not too many of their repositories, looks like
a live credential of theirs; one that many hold is a copied example, and so is
one that an owner's template puts everywhere.  Few means MAX_OWNERS, and not
over MAX_SHARE of all owners where owners are few, and MAX_REPOSITORIES.
Counting goes by (value, owner, repository) first, then by (value, owner) and
by value, each with map-side combining, so a value copied into a third of all
rows makes no hot task; where counts are joined back, rows of such a value are
dealt out over salts (see functions/skew.py).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dieflow.functions.skew import LEAST_ROWS, hot_join
from dieflow.llm.common import cut, fresh, map_batches

KINDS = ("assign", "access", "hex", "owned")
MAX_OWNERS, MAX_SHARE = 2, 0.1
MAX_REPOSITORIES = 100
MIN_ENTROPY = 3.2

_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def scan(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, hash of the value) of every candidate, in code points, sorted; kinds are indexes of KINDS.

    The first three kinds are leftmost non-overlapping matches of their own
    pattern and may overlap one another.  The last is any other run of 20 or
    more token characters with letters, digits and enough entropy that touches
    none of those.  The cost grows with the text and the number of candidates.
    """
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    base, at = _united((s, e) for s, _, e, _ in found), 0
    for m in _TOKEN.finditer(text):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        if at < len(base) and base[at][0] < m.end():
            continue
        v = m[0]
        if not v.isalpha() and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= MIN_ENTROPY:
            found.append((m.start(), 3, m.end(), v))
    return sorted((s, k, e, xxhash.xxh64_intdigest(v.encode()) - (1 << 63)) for s, k, e, v in found)


_FOUND = "array<struct<start:int,kind:int,end:int,h:bigint>>"


def candidates(docs: DataFrame, text: str = "text", name: str = "found") -> DataFrame:
    """docs and, under a new name, an array of struct(start, kind, end, h); null texts have none."""
    at = docs.columns.index(text)
    item = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("h", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("start", "kind", "end", "h"), x)) for x in scan(t or "")] for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(item))], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{schema}, `{name}` {_FOUND}")


def ownership(held: DataFrame) -> DataFrame:
    """(h, owners, repositories): how many distinct owners, and repositories of theirs, hold each value, from rows (h, owner, repository).

    Rows without an owner or repository count as those of one.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = held.select("h", text("owner").alias("owner"), text("repository").alias("repository")).distinct()
    by_owner = each.groupBy("h", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def few_owners(owners: DataFrame, most: int = MAX_OWNERS, share: float = MAX_SHARE) -> int:
    """How many owners a live value may have, given a column of all rows' owners."""
    return max(1, min(most, int(share * owners.distinct().count())))


_SPANS = "array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,live:boolean>>"


def _listed(found: DataFrame, most: int, repositories: int, slots: int | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """(row, spans) of the rows that have any, from rows (row, owner, repository, found)."""
    each = found.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    met = hot_join(each.select("h", "row", "start", "kind", "end"), ownership(each), ["h"], slots=slots, least=least, by=["row", "start", "kind"])
    judged = met.withColumn("live", (F.col("owners") <= most) & (F.col("repositories") <= repositories))
    span = F.struct("start", "kind", "end", "owners", "repositories", "live")
    return judged.where((F.col("kind") < 3) | F.col("live")).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repository: str | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row for each row of docs: doc_id and `spans`, an array of struct(start, kind, end, owners, repositories, live), sorted.

    Base kinds are always listed, live or not; a span of kind "owned" is listed
    only if it is live, that is if few enough owners and repositories hold its
    value.  A repository is a document unless a column names it.  Null and empty texts have no spans.
    Repeated rows stay repeated, each with the same spans.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.col(repository or doc_id).alias("repository"), F.col(text).cast("string").alias("text"))
    found = cut(candidates(given).select("doc_id", "owner", "repository", "found", F.monotonically_increasing_id().alias("row")), "secrets")
    spans = _listed(found, few_owners(found.select("owner"), max_owners), max_repositories)
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, as strings kind:start:end joined by commas; live has those that look live."""
    kinds = F.array(*(F.lit(k) for k in KINDS))

    def joined(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), joined(F.filter("spans", lambda s: s["live"])).alias("live"))


def mask_spans(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """text with the spans, which are sorted and may overlap, replaced by the mask."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repository: str | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, mask: str = "[secret]") -> DataFrame:
    """docs with every listed span of `text` replaced by the mask; a column n_chars follows the text.

    Base spans go whoever owns them, "owned" ones if they are live.  Null texts
    stay null; repeated rows stay repeated.  Rows are numbered in the written
    table of what was found, and only those with a candidate of kind "owned",
    whose owners must be counted, are dealt out to meet their spans.
    """
    columns = docs.columns
    row, found, live = fresh(docs, "row", "found", "live")
    scanned = cut(candidates(docs, text, found).withColumn(row, F.monotonically_increasing_id()), "scanned")
    most = few_owners(scanned.select(owner), max_owners)
    narrow = scanned.select(F.col(row).alias("row"), F.col(owner).alias("owner"), F.col(repository or doc_id).alias("repository"), F.col(found).alias("found"))
    owned = narrow.withColumn("found", F.filter("found", lambda f: f["kind"] == 3)).where(F.size("found") > 0)
    spans = _listed(owned, most, max_repositories).select(F.col("row").alias(row), F.transform("spans", lambda s: s["start"]).alias(live))
    some = F.exists(found, lambda f: f["kind"] == 3)
    plain = scanned.where(~some).select(*columns, found, F.expr("cast(array() as array<int>)").alias(live))
    mixed = scanned.where(some).join(spans, row, "left").select(*columns, found, F.coalesce(live, F.expr("cast(array() as array<int>)")).alias(live))
    at, chars = columns.index(text), columns.index("n_chars") if "n_chars" in columns else -1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        out, touched = list(texts), []
        for i, (f, kept) in enumerate(zip(batch.column(len(columns)).to_pylist(), map(set, batch.column(len(columns) + 1).to_pylist()))):
            masked = sorted((x["start"], x["end"]) for x in f if x["kind"] < 3 or x["start"] in kept)
            if masked:
                out[i] = mask_spans(texts[i], masked, mask)
                touched.append(i)
        arrays = [*batch.columns[:-2]]
        arrays[at] = pa.array(out, batch.schema.types[at])
        if chars >= 0:
            n = batch.column(chars).to_pylist()
            for i in touched:
                n[i] = len(out[i])
            arrays[chars] = pa.array(n, batch.schema.types[chars])
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_batches(plain.unionAll(mixed), run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))

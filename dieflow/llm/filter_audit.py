"""How document filters interact, whatever the order they are applied in.

Each document is reduced to the set of filters it fails.  It contributes to
one edge of the subset lattice for each (already applied subset, next filter):
kept, removed, or failing a filter though removed before.  Edges are added up
once, and every order of the filters is a path over them: its k-th step is the
edge (set of its first k-1 filters, its k-th).  Orders are thus joined to 80
edges, and never to documents.

Failures are built-in expressions over whole texts.  Beyond the scan only
(id, digest of the text, failure set) moves.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dieflow.functions.skew import LEAST_ROWS, hot_join
from dieflow.llm.common import cut, let

FILTERS = "ABCDE"
#: The one filter that isn't a matter of the text alone: an identical text has a smaller id.
COPY = 16
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, 0 to 15; null counts as the empty text."""

    def of(t: Column) -> Column:
        def counted(words: Column) -> Column:
            a = F.size(words) < 100
            b = 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)
            c = 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > 10 * F.char_length(t).cast("long")
            d = t.rlike("[#$%&*|]")
            return sum((x.cast("int") * (1 << i) for i, x in enumerate((a, b, c, d))), F.lit(0))

        return let(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""), counted)

    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), a row an id that is one of both; an id labelled repeatedly is what any of its rows says."""
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    return labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy("doc_id").agg(F.coalesce(one("quality"), F.lit(0)).alias("good"), F.coalesce(one("toxic"), F.lit(0)).alias("toxic"))


def failure_cells(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang", slots: int | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failure set and labels, at most 128 rows a part.

    A text's copies fail E but for those rows that have its smallest id.  Equal
    texts fail alike otherwise, so copies are counted by (text, part, labels)
    before any of them meet: what meets for one text is a row a part and label,
    and not its documents.  Rows without an id are no copies and make none, and
    have no labels.  Texts are told apart by SHA-256.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    seen = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), failures(F.col(text)).alias("mask"))
    alike = cut(seen.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "failures")
    ids = alike.groupBy("doc_id").count()
    known = hot_join(alike, labelled(labels), ["doc_id"], "left", counted=ids, slots=slots, least=least)
    key = ("digest", "part", "mask", "good", "toxic")
    marked = known.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    copies = marked.groupBy(*key).agg(F.sum("n").alias("all"), F.min(named).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least_id = F.min("first.doc_id").over(W.partitionBy("digest"))
    own = F.col("nameless") + F.when(F.col("first.doc_id") == least_id, F.col("first.n")).otherwise(0)
    counted = copies.select("part", "mask", "good", "toxic", own.alias("own"), "all")
    two = F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("all") - F.col("own")).alias("n")))
    split = counted.select("part", "good", "toxic", F.explode(two).alias("x"))
    return split.select("part", "good", "toxic", "x.*").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(cells: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, applied, next) and the measures: an edge for each subset and each filter outside it, 80 of 5 filters, zeros included."""
    edges = [(s, f) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in edges)))
    rows = cells.select("part", "mask", "good", "toxic", "n", each.alias("e")).select("*", "e.applied", "e.next").drop("e")
    bit = F.call_function("shiftleft", F.lit(1), F.col("next"))
    before, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(bit) != 0
    removed = fails & ~before

    def n(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    sums = (n(~before & ~fails), n(removed), n(fails & before), n(F.col("mask") == bit), n(removed & (F.col("good") == 1)), n(removed & (F.col("toxic") == 1)))
    return rows.groupBy("part", "applied", "next").agg(*(s.cast("long").alias(name) for s, name in zip(sums, MEASURES)))


def path_steps(names: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, applied, next) of every order of the filters: 600 steps of 5 filters."""
    out = []
    for order in permutations(range(len(names))):
        applied = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, applied, f))
            applied |= 1 << f
    return out


def along_paths(edges: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every order's steps with their edge's measures, and shapley: the filter's removed, added up over all orders."""
    spark = edges.sparkSession
    steps = F.broadcast(spark.createDataFrame(path_steps(names), "filter_order string, step int, applied int, next int"))  # a fixed number of rows
    rows = edges.join(steps, ["applied", "next"])
    total = F.sum("removed").over(W.partitionBy("part", "next")).alias("shapley")
    return rows.select("part", "filter_order", "step", *MEASURES, total)


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: 600 rows a part.

    A null part is the empty one, a null text the empty text.  Repeated rows
    count repeatedly, and are no copies of each other.  An empty table has no
    parts and gives no rows.  Other columns are ignored.
    """
    return along_paths(lattice_edges(failure_cells(docs, labels, text, doc_id, part)))

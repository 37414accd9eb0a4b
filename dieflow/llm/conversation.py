"""Conversations repaired at least cost, each distinct signature solved once.

A conversation is a sequence of rows, of which the repair needs one letter
each: the role's initial, in upper case if the text is cut short, or x if the
row must go.  Signatures of up to CHUNK letters are collected, and each
distinct one is solved once, by memoised recursion, for the automaton of legal
role sequences; audits are joined back and edits replayed over the texts.

A longer conversation is several signatures.  Each is solved for every state
it may be entered and left in; a fold over the costs picks one for each, so
the solution is that of the whole.  No two cheapest edit sequences of a chunk
begin with one another, hence the least of the whole is the least chunk by
chunk.

The digest of a repaired conversation is one hash over all its texts, in
order: rows stream through it sorted, and nothing of a conversation but its
audit is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dieflow.functions.skew import LEAST_ROWS, hot_join
from dieflow.llm.common import cut, map_batches, small_batches, utf8

#: Rows of one signature.
CHUNK = 128
DROP, EMPTY, UNSTOP, REPEAT, REROLE = range(5)
SPACE = " \t\n\v\f\r"
COUNTS = ("blank", "duplicate", "truncated", "illegal")

# Legal role sequences, (s?(ua)+)?, as an automaton: states, arcs by initial, and the state the next made-up row leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
_ARC = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NEXT = (USER, USER, ASSISTANT, USER)
_ENDS = (START, ASSISTANT)
_FIX, _DELETE, _REROLE, _INSERT = 3, 4, 3, 3


def solve(signature: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of the cheapest edits that lead from one state to another over the signature's rows, the ASCII-least of equal ones.

    Only a first signature starts at START, and that alone; a last one ends in
    an accepting state.  Rows are made up before the row they stand in front
    of, or at the end of all.
    """
    n, memo = len(signature), {}

    def best(i: int, state: int, spare: int) -> dict[int, tuple[int, str]]:
        # By final state; `spare` rows may still be made up in a row, beyond which one only comes back to a state at a cost.
        if (key := (i, state, spare)) in memo:
            return memo[key]
        found: dict[int, tuple[int, str]] = {}

        def offer(cost: int, letter: str, rest: dict[int, tuple[int, str]]) -> None:
            for to, (c, audit) in rest.items():
                if to not in found or (cost + c, letter + audit) < found[to]:
                    found[to] = (cost + c, letter + audit)

        if i == n:
            if not last or state in _ENDS:
                offer(0, "", {state: (0, "")})
            if last and spare:
                offer(_INSERT, "I", best(i, _NEXT[state], spare - 1))
        else:
            letter = signature[i]
            offer(_DELETE, "D", best(i + 1, state, 2))
            if letter != "x":
                fix = _FIX if letter.isupper() else 0
                kept = _ARC.get((state, letter.lower()))
                if kept is not None:
                    offer(fix, "K", best(i + 1, kept, 2))
                offer(fix + _REROLE, "R", best(i + 1, _NEXT[state], 2))
            if spare:
                offer(_INSERT, "I", best(i, _NEXT[state], spare - 1))
        memo[key] = found
        return found

    for i in range(n, -1, -64):  # fill the memo from the end, so that no call goes deep
        for state in range(4):
            best(i, state, 2)
    out = []
    for state in (START,) if first else range(4):
        out += [(state, to, c, a) for to, (c, a) in best(0, state, 2).items()]
    if last:  # which accepting state it ends in doesn't matter any more
        out = [min((o for o in out if o[0] == s), key=lambda o: (o[2], o[3])) for s in sorted({o[0] for o in out})]
    return sorted(out)


_PLANS = "array<struct<start:int,stop:int,cost:int,audit:string>>"


def solved(signatures: DataFrame) -> DataFrame:
    """signatures (signature, first, last) with `plans`, all of solve()."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [c.to_pylist() for c in batch.columns]
        plans = [[dict(zip(("start", "stop", "cost", "audit"), p)) for p in solve(*k)] for k in zip(*keys)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int32()), ("audit", pa.string())]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(plans, kind)], names=["signature", "first", "last", "plans"])

    return map_batches(signatures.select("signature", "first", "last"), run, f"signature string, first boolean, last boolean, plans {_PLANS}")


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and dead, of every row: damage by a checksum of conv_id:turn, 5 in 20 rows.

    A null role or text counts as one space, in the checksum also a null id or
    turn.  Rows that drop out stay, marked dead, so that no conversation is lost.
    """
    code = F.crc32(F.encode(F.concat(_shown(conv_id), F.lit(":"), _shown(turn)), "utf-8")) % 20
    new_role = F.when(code == REROLE, F.lit("user")).otherwise(_shown(role))
    new_text = F.when(code == EMPTY, F.lit("")).when(code == UNSTOP, F.regexp_replace(_shown(text), "[.!?]", "")).otherwise(_shown(text))
    given = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), new_role.alias("role"), new_text.alias("text"), (code == DROP).alias("dead"), F.when(code == REPEAT, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))).alias("times"))
    return given.withColumn("times", F.explode("times")).drop("times")


def _in_order(*before: Column) -> W:
    """Rows of a conversation by turn; of one turn, by role and by a digest of the text."""
    return W.partitionBy("conv_id").orderBy(*before, F.asc_nulls_first("turn"), "role", "digest")


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, signature, first, last, counts): the signatures of damaged rows, and how many rows have each fault.

    A row's first fault counts: blank, a duplicate (same role and text before
    it) or cut short.  A conversation without rows left has one empty signature.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select("conv_id", "turn", "dead", "role", F.unhex(F.md5("text")).alias("digest"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    w = _in_order(F.col("dead"))
    initial = F.substring("role", 1, 1)
    ordered = narrow.select("*", (F.row_number().over(w) - 1).alias("pos"), F.lag(initial).over(w).alias("before"), F.lag("turn").over(w).alias("turn_before"), F.count(F.when(~F.col("dead"), 1)).over(W.partitionBy("conv_id")).alias("n"))
    again = F.row_number().over(W.partitionBy("conv_id", "dead", "role", "digest").orderBy("pos")) > 1
    kind = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    faulty = ordered.withColumn("again", again).withColumn("fault", kind)
    alive = ~F.col("dead")

    def count(condition: Column) -> Column:
        return F.coalesce(F.count(F.when(alive & condition, 1)), F.lit(0))

    illegal = F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & ((F.col("pos") == 0) | ~F.col("turn").eqNullSafe(F.col("turn_before")))
    faults = [count(F.col("fault") == f).alias(f) for f in COUNTS[:3]]
    turns = [F.min(F.when(alive, F.col("turn"))).alias("low"), F.max(F.when(alive, F.col("turn"))).alias("high"), count(new_turn).alias("turns")]
    at = F.when(alive, (F.col("pos") / size).cast("long")).otherwise(F.lit(0)).alias("chunk")
    letters = F.sort_array(F.collect_list(F.when(alive, F.struct("pos", letter.alias("letter")))))
    grouped = faulty.groupBy("conv_id", at).agg(F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("signature"), F.max("n").alias("n"), *faults, count(illegal).alias("illegal"), *turns)
    last = F.col("chunk") >= ((F.col("n") - 1) / size).cast("long")
    return grouped.select("conv_id", "chunk", "signature", (F.col("chunk") == 0).alias("first"), last.alias("last"), *COUNTS, "low", "high", "turns")


def picked(table: pa.Table, block: int = 4096) -> np.ndarray:
    """Which plan each of a conversation's chunks takes, from (chunk, costs) rows sorted by chunk.

    Costs are read backwards by blocks; for each chunk and state it is entered
    in, the choice and where it leads are two bytes.
    """
    n = table.num_rows
    choice, leads = np.zeros((n, 4), np.int8), np.zeros((n, 4), np.int8)
    ahead = [0] * 4  # cost of all later chunks, by state they are entered in
    for end in range(n, 0, -block):
        start = max(0, end - block)
        for i, plans in zip(range(end - 1, start - 1, -1), reversed(table.column("costs").slice(start, end - start).to_pylist())):
            here: dict[int, tuple[int, int, int, int]] = {}
            for at, p in enumerate(plans):
                offer = (p["cost"] + ahead[p["stop"]], p["rank"], p["stop"], at)
                here[p["start"]] = min(offer, here.get(p["start"], offer))
            ahead = [here[s][0] if s in here else 1 << 60 for s in range(4)]
            for s, (_, _, stop, at) in here.items():
                choice[i, s], leads[i, s] = at, stop
    state, out = START, np.zeros(n, np.int32)
    for i in range(n):
        out[i], state = choice[i, state], leads[i, state]
    return out


def planned(given: DataFrame, slots: int | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """chunks with `audit` and `cost` in place of their signature.

    Signatures are joined to their solutions; those that many conversations
    share are dealt out.  Conversations of one chunk have one plan; for the
    others a plan is picked for each chunk, from costs and ranks alone, which take a few bytes a row of the conversation.
    """
    key = ["signature", "first", "last"]
    counted = cut(given.groupBy(*key).count(), "signatures")
    plans = cut(solved(counted), "plans")
    met = hot_join(given, plans, key, "inner", counted=counted, slots=slots, least=least)
    whole = met.where(F.col("first") & F.col("last")).withColumn("plan", F.get("plans", F.lit(0)))
    parts = met.where(~(F.col("first") & F.col("last")))
    rank = lambda p, ps: F.size(F.filter(ps, lambda q: (q["start"] == p["start"]) & (q["audit"] < p["audit"])))
    costs = F.transform("plans", lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), p["cost"].alias("cost"), rank(p, F.col("plans")).alias("rank")))
    named = parts.select("conv_id", "chunk", costs.alias("costs"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk")
        return pa.table([rows.column("conv_id"), rows.column("chunk"), pa.array(picked(rows))], names=["conv_id", "chunk", "pick"])

    picks = named.groupBy("conv_id").applyInArrow(run, f"conv_id {dict(given.dtypes)['conv_id']}, chunk long, pick int")
    told = parts.join(picks.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "pick"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    columns = ("conv_id", "chunk", *COUNTS, "low", "high", "turns", "plan.audit", F.col("plan.cost").cast("long").alias("cost"))
    return whole.select(*columns).unionAll(told.withColumn("plan", F.get("plans", F.col("pick"))).select(*columns))


class _Replay:
    """One conversation being read: its audit, then its rows in order."""

    def __init__(self) -> None:
        self.audit: list[str] = []
        self.sha, self.lines, self.edits, self.system = hashlib.sha256(), 0, None, False

    def _line(self, role: bytes, text: bytes) -> None:
        self.sha.update(b"\n" * (self.lines > 0) + role + b":")
        self.sha.update(text)
        self.lines += 1

    def _made(self) -> bytes:
        return b"user" if (self.lines - self.system) % 2 == 0 else b"assistant"

    def _upto_row(self) -> str:
        """The edit of the next row; rows made up before it are written."""
        for e in self.edits:
            if e != "I":
                return e
            self._line(self._made(), b"")
        return ""

    def row(self, role: bytes, text: bytes) -> None:
        if self.edits is None:
            self.edits = iter("".join(self.audit))
        edit = self._upto_row()
        if edit == "K":
            self.system |= not self.lines and role[:1] == b"s"
            self._line(role, text)
        elif edit == "R":
            self._line(self._made(), text)

    def end(self) -> tuple[str, str]:
        if self.edits is None:
            self.edits = iter("".join(self.audit))
        self._upto_row()
        return "".join(self.audit), self.sha.hexdigest()


def replayed(plans: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256, counts, cost and turns) from planned chunks and damaged rows.

    Both are dealt out by conversation and sorted, its chunks first; then one
    pass holds an audit and a hash, whatever the length of the conversation.
    """
    extra = [*COUNTS, "low", "high", "turns", "cost"]
    nothing = [F.lit(None).cast(dict(plans.dtypes)[c]).alias(c) for c in extra]
    none = F.lit(None)
    head = plans.select("conv_id", F.lit(0).alias("kind"), F.col("chunk"), none.cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("role"), none.cast("binary").alias("digest"), F.col("audit").alias("text"), *extra)
    body = rows.where(~F.col("dead")).select("conv_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("chunk"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text", *nothing)
    both = head.unionAll(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "chunk", F.asc_nulls_first("turn"), "role", "digest")
    names = ["conv_id", "audit", "repaired_sha256", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, sums, types = None, None, [], []

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            types = [batch.schema.field(0).type, pa.string(), pa.string(), *(batch.schema.field(c).type for c in extra)]
            done = []
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), *(batch.column(4 + i).to_pylist() for i in range(len(extra)))]
            for c, kind, role, text, *more in zip(*columns):
                if now is None or c != conv:
                    if now is not None:
                        done.append((conv, *now.end(), *sums))
                    conv, now, sums = c, _Replay(), [None] * len(extra)
                if kind:
                    now.row(role, text)
                    continue
                now.audit.append(text.decode())
                for i, v in enumerate(more):
                    both = [x for x in (sums[i], v) if x is not None]
                    sums[i] = {"low": min, "high": max}.get(extra[i], sum)(both) if both else None
            yield rows(done)
        if now is not None:
            yield rows([(conv, *now.end(), *sums)])

    given = both.select("conv_id", "kind", "role", "text", *extra)
    kinds = dict(given.dtypes)
    return small_batches(given).mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = CHUNK) -> DataFrame:
    """Every conversation's faults after damage, cheapest edits and the digest of what they leave: one row a conv_id, a null one included.

    Rows of one turn are read in order of role and of a digest of their text,
    so equal rows and ties have one result.  A conversation without rows left
    has zeros, an empty audit and the empty string's digest.  No rows give no rows.
    """
    hurt = damaged(rows, conv_id, turn, role, text)
    done = replayed(planned(cut(chunks(hurt, size), "chunks")), hurt)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return done.select("conv_id", gaps.cast("long").alias("gaps"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "cost")), "audit", "repaired_sha256")

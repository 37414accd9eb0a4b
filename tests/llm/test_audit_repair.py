"""Filter audit and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from dieflow.llm import conversation, filter_audit

DOCS = "doc_id bigint, text string, lang string, source string"


# --- 11 ---


def audit_by_hand(docs, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))

    def fails(d, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and least[t] < d)
        return {f for f, x in zip("ABCDE", tests) if x}

    rows = [(lang or "", fails(d, t or ""), d in good, d in toxic) for d, t, lang, *_ in docs]
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in rows if r[0] == part)
                alone = sum(r[1] == {f} for r in rows if r[0] == part)
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audit_rows(seed, n=150):
    rng = random.Random(seed)
    texts = ["", None, " \t", "A B C", "a" * 5, "x$y", " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i % 60}" for i in range(130)), " ".join(f"Word{i}" for i in range(100)), "ÄÖ É", "#", " ".join(["Long"] * 20_000)]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""]), "s") for _ in range(n)]
    return docs + docs[:10], [(rng.choice([None, *range(70)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]


@pytest.mark.parametrize("least", [3, 100_000])
def test_audit_equals_brute_force(spark, least):
    docs, labels = audit_rows(least)
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("part", "mask", "n", "digest", "good")})
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit("x"))
    cells = filter_audit.failure_cells(df, marks, slots=4, least=least)
    got = Counter(map(tuple, filter_audit.along_paths(filter_audit.lattice_edges(cells)).collect()))
    assert got == audit_by_hand(docs, labels) and all(v == 1 for v in got.values())


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(None, None, None, None)], DOCS)
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows if r.step == 1) == 24


def test_lattice_has_80_edges_and_600_steps():
    steps = filter_audit.path_steps()
    assert len(steps) == 600 and len({s[2:] for s in steps}) == 80


# --- 12 ---

LEGAL = re.compile("(s?(ua)+)?")


def legal(initials):
    return all(len(i) == 1 for i in initials) and LEGAL.fullmatch("".join(initials)) is not None


def cheapest_by_hand(rows):
    """Every edit sequence of at most two made-up rows before each row and at the end, without dynamic programming."""
    best = None
    pieces = []
    for initial, fault in rows:
        ops = [("D", 4, [])]
        if fault not in ("blank", "duplicate"):
            fix = 3 if fault == "truncated" else 0
            ops += [("K", fix, [initial]), ("R", fix + 3, ["u"]), ("R", fix + 3, ["a"])]
        made = [("", 0, []), ("I", 3, ["u"]), ("I", 3, ["a"])]
        pieces.append([(i + o, ci + co, ri + ro) for i, ci, ri in made for o, co, ro in ops])
    pieces.append([("", 0, []), ("I", 3, ["u"]), ("I", 3, ["a"]), ("II", 6, ["u", "a"])])
    for choice in product(*pieces):
        roles = [r for c in choice for r in c[2]]
        if legal(roles):
            offer = (sum(c[1] for c in choice), "".join(c[0] for c in choice), tuple(roles))
            best = offer if best is None or offer < best else best
    return best


def repair_by_hand(rows):
    show = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = ("user" if code == 4 else show(role)), ("" if code == 1 else re.sub("[.!?]", "", show(text)) if code == 2 else show(text))
        convs.setdefault(conv, []).extend([] if code == 0 else [(turn, role, text)] * (2 if code == 3 else 1))
    out = {}
    for conv, given in convs.items():
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in given:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, *_ in given if t is not None]
        initials = [r[1][:1] for r in given]
        cost, audit, roles = cheapest_by_hand(list(zip(initials, faults)))
        lines, at, queue = [], 0, list(roles)
        for e in audit:
            if e == "I":
                lines.append({"u": "user", "a": "assistant"}[queue.pop(0)] + ":")
                continue
            _, role, text = given[at]
            at += 1
            if e == "K":
                queue.pop(0)
                lines.append(f"{role}:{text}")
            elif e == "R":
                lines.append({"u": "user", "a": "assistant"}[queue.pop(0)] + ":" + text)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum("".join(p) not in ("su", "ua", "au") for p in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def turns(seed, conversations=60, longest=4):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "agent"], ["Hi.", "Yes!", "no end", None, "", " \n", "Why?  \n", "ünï. code", "Hi."]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(conversations)] for _ in range(rng.randrange(1, longest + 1))]
    return rows + rows[:3]


@pytest.mark.parametrize("size", [1, 2, 128])
def test_repair_equals_brute_force(spark, size):
    rows = [r for r in turns(size) if r[0] is None or r[0] > 2]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("x") for c in ("kind", "chunk", "audit", "dead", "n")})
    got = {r.conv_id: tuple(r)[1:] for r in conversation.repair(df, size=size).collect()}
    assert got == repair_by_hand(rows)


def test_chunks_give_the_audit_of_the_whole():
    rng = random.Random(5)
    for _ in range(150):
        s = "".join(rng.choice("suaoxSUAO") for _ in range(rng.randrange(1, 40)))
        whole = conversation.solve(s, True, True)[0]
        parts = [s[i : i + 7] for i in range(0, len(s), 7)]
        best = {conversation.START: (0, "")}
        for i, p in enumerate(parts):
            step = {}
            for start, stop, cost, audit in conversation.solve(p, i == 0, i == len(parts) - 1):
                if start in best:
                    offer = (best[start][0] + cost, best[start][1] + audit)
                    step[stop] = min(offer, step.get(stop, offer))
            best = step
        assert min(best.values()) == whole[2:]


def test_one_very_long_conversation(spark):
    n = 5000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    both = rows.unionAll(rows.where("turn < 3").withColumn("conv_id", F.lit(2).cast("long")))
    a, b = ({r.conv_id: tuple(r) for r in conversation.repair(both, size=s).collect()} for s in (128, 16))
    assert a == b and len(a) == 2
    assert sum(e != "I" for e in a[1][7]) == sum(2 if c == 3 else 1 for t in range(n) if (c := zlib.crc32(f"1:{t}".encode()) % 20))


def test_conversation_without_rows_left(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert [tuple(r) for r in conversation.repair(spark.createDataFrame([(9, turn, "user", "Hi.")], schema)).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation.repair(spark.createDataFrame([], schema)).count() == 0

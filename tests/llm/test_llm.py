"""The training-data operators against brute force, on small fixtures and on the smallest tables."""

import hashlib
import html
import json
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dieflow.llm import bpe, decontam, html_main, ngram_lm, quality, queries, secret_scan, sharding, simhash, toxicity, urlfilter
from dieflow.llm.common import word_blocks
from dieflow.llm.components import connected_components
from test_near import kept_by_hand

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977} und" for i in range(60_000))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_rows():
    """Nulls, empty, very long, ties and repeated rows."""
    base = [(1, "The cat sat on the mat. " * 12, "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n", "en", "b", 3), (5, LONG, "de", "a", len(LONG))]
    return [*base, base[0], (6, base[0][1], "en", "c", 1), (None, "no id here at all", None, None, None), (None, None, None, None, None), (7, "Ünï çödé — \U0001f600 #*$ <|endoftext|> don't  x", "fr", "c", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    # A column more, with a name that operators use themselves.
    return spark.createDataFrame(odd_rows(), DOCS).withColumn("row", F.lit("x")).withColumn("quality", F.lit(1))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1 ---


def simhash_by_hand(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(rows, radius=2):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for d, f in rows:
        if d is not None:
            least[find(f)].append(d)
    return Counter((d, f"{f:016x}", min(least[find(f)], default=None)) for d, f in rows)


@pytest.mark.parametrize("bucket", [256, 1])
def test_simhash(spark, docs, odd, none, bucket):
    for df in (docs, odd):
        rows = [(r.doc_id, simhash_by_hand(r.text)) for r in df.select("doc_id", "text").collect()]
        got = simhash.groups(df, bucket=bucket).select("doc_id", simhash.hex_digits(), "component_id")
        assert Counter(tuple(r) for r in got.collect()) == components_by_hand(rows)
    assert simhash.groups(none).count() == 0


def test_texts_are_read_by_stretches(monkeypatch):
    text = ("Ünï  A b\tc\n" * 40 + "x").encode()
    whole = [w for b in word_blocks(text) for w in b]
    want = [simhash.fingerprint(text, n) for n in (1, 3, 5)]
    for size in (1, 5, 64):
        assert [w for b in word_blocks(text, size) for w in b] == whole
        monkeypatch.setattr(simhash, "word_blocks", lambda t, size=size: word_blocks(t, size))
        assert [simhash.fingerprint(text, n) for n in (1, 3, 5)] == want
        assert simhash.fingerprint(b"a b", 3) == simhash.fingerprint(b" A\nb ", 3) != 0


def test_covering_masks_cover():
    rng = random.Random(1)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            differ = sum(1 << p for p in rng.sample(range(64), radius))
            assert any(not m & differ for m in masks)


def test_simhash_near_bits(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(4))) for _ in range(30)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for bucket in (256, 2):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), bucket=bucket)
        got = {r.node: r.root for r in connected_components(edges).collect()}
        by = defaultdict(set)
        for (f,) in signed:
            by[got.get(f, f)].add(f)
        want = components_by_hand([(f, f & (2**64 - 1)) for (f,) in signed])
        assert {frozenset(v) for v in by.values()} == {frozenset(d for d, _, c in want if c == k) for k in {c for _, _, c in want}}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives(odd, none):
    got = sorted((r.doc_id for r in simhash.representatives(odd).collect()), key=str)
    assert got == [1, 2, 5, 7, None, None] and simhash.representatives(none).count() == 0


# --- 2 ---


def measures_by_hand(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, docs, odd, none):
    for df in (docs, odd):
        for r in quality.quality(df).collect():
            q = r.quality
            want = measures_by_hand(r.text)
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
            assert q.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (q.kept and q.base_failed)
    assert quality.quality(none).count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    scored = quality.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not quality.base_failed").select("doc_id", "quality.kept").collect()
    known = [(labels[r.doc_id], r.kept) for r in scored if r.doc_id in labels]
    assert sum(k == bool(y) for y, k in known) >= 0.97 * len(known)


# --- 3 ---


@pytest.fixture(scope="module")
def pair():
    import tokenizers

    path = queries.tokenizer_path()
    return bpe.Bpe(open(path, "rb").read()), tokenizers.Tokenizer.from_file(path)


def same(pair, text, size=bpe.BLOCK):
    mine, theirs = pair
    want = theirs.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(b"".join(bpe.encode(mine, bpe.pieces(text, size))), dtype="<u4").tolist()
    assert got == want, (text[:80], size)
    assert "".join(bpe.decode(mine, [mine.pack(want[:3]), mine.pack(want[3:])])) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_equals_the_library(pair, monkeypatch):
    rng = random.Random(4)
    for _ in range(600):
        text = "".join(rng.choice("aabcdeè '!?\n\t  stre<|endoftext|>1239日本ł  \x1c\x85\u00a0") for _ in range(rng.randrange(50)))
        same(pair, text)
        same(pair, text + "<|endoftext|>" + text[:5], rng.randrange(1, 9))
    for cp in [*range(0x250), *range(0x2000, 0x3100, 3), *range(0x1F300, 0x1F700, 41)]:
        same(pair, f"a{chr(cp)}1 {chr(cp)}{chr(cp)}b!")
    monkeypatch.setattr(bpe, "BLOCK", 60)
    parts = ["a" * 199, "xyz" * 60, " " * 77, "\n" * 50, "'" * 90, "s", "'re", "1" * 150, " b", "!", "entertainment" * 25]
    for _ in range(300):
        same(pair, "".join(rng.choice(parts) for _ in range(7)), 60)


def test_bpe_holds_little(pair):
    mine = pair[0]
    word = bpe.WordStream(mine)
    out = []
    for _ in range(400):
        out.append(word.feed(b"abcdefgh" * 20))
        assert len(word.held) < 2 * mine.lookahead + 160 + 200
    whole = mine.merge(b"abcdefgh" * 8000)
    assert np.frombuffer(b"".join([*out, word.finish()]), dtype="<u4").tolist() == whole
    assert 100 < mine.lookahead < 5000


def test_lookahead_of_any_merge_list(monkeypatch):
    rng = random.Random(6)
    for _ in range(150):
        known, rules = [b"a", b"b", b"c"], []
        for _ in range(rng.randrange(1, 14)):
            u, v = rng.choice(known), rng.choice(known)
            if u + v not in known and len(u + v) < 12:
                known.append(u + v)
                rules.append((u, v))
        vocab = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(known[3:])}
        shown = bpe.byte_alphabet()
        given = {"model": {"type": "BPE", "vocab": {"".join(shown[b] for b in t): i for t, i in vocab.items()}, "merges": ["".join(shown[b] for b in u) + " " + "".join(shown[b] for b in v) for u, v in rules]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "normalizer": None, "added_tokens": []}
        mine = bpe.Bpe(json.dumps(given).encode())
        monkeypatch.setattr(bpe, "STEP", rng.randrange(1, 5))
        for _ in range(12):
            word, stream, at, out = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 90))), bpe.WordStream(mine), 0, []
            while at < len(word):
                n = rng.randrange(1, 4)
                out.append(stream.feed(word[at : at + n]))
                at += n
            want = mine.pack(mine.merge(word))
            assert b"".join([*out, stream.finish()]) == want == bpe.WordStream(mine).whole(word)


def test_every_word_goes_through_the_transducer(pair, docs, monkeypatch):
    mine, theirs = bpe.Bpe(open(queries.tokenizer_path(), "rb").read()), pair[1]
    fed, early = Counter(), Counter()
    feed = bpe.WordStream.feed

    def spied(self, piece):
        out = feed(self, piece)
        fed[piece] += 1
        early["tokens"] += len(out) // 4
        return out

    monkeypatch.setattr(bpe.WordStream, "feed", spied)
    monkeypatch.setattr(bpe, "STEP", 4)
    words = set()
    for r in docs.select("text").collect():
        want = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(b"".join(bpe.encode(mine, bpe.pieces(r.text or ""))), dtype="<u4").tolist() == want
        words |= {w.encode() for w in mine.split.findall(r.text or "")}
    assert all(w[at : at + 4] in fed for w in words for at in range(0, len(w), 4))
    assert early["tokens"] > 0.05 * len(words)  # tokens that came before their word had ended


def test_bpe_documents(odd, none, pair):
    path = queries.tokenizer_path()
    want = Counter()
    for d, t, *_ in odd_rows():
        ids = pair[1].encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(pair[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digest_documents(odd, path).collect()) == want
    both = bpe.decode_documents(bpe.encode_documents(odd, path), path, text="again")
    assert both.where("coalesce(text, '') <> again").count() == 0 and both.count() == len(odd_rows())
    assert bpe.digest_documents(none, path).count() == 0


# --- 4 ---


def shards_by_hand(rows, shards, slots):
    """{row: (vslot, shard)}, shards' bytes, by the slots' owners: heaviest slot first, each to the lightest shard."""
    size = lambda t: len((t or "").encode()) + 16
    of = lambda d, t: xxhash.xxh64(struct.pack("<q", d) if d is not None else (t or "").encode(), 42).intdigest() - (1 << 64) * (xxhash.xxh64(struct.pack("<q", d) if d is not None else (t or "").encode(), 42).intdigest() >> 63)
    slot = [of(d, t) % slots for d, t in rows]
    load = Counter()
    for s, (_, t) in zip(slot, rows):
        load[s] += size(t)
    total, held, owner = [0] * shards, [0] * shards, {}
    for s in sorted(range(slots), key=lambda s: (-load[s], s)):
        k = min(range(shards), key=lambda k: (total[k], held[k], k))
        owner[s], total[k], held[k] = k, total[k] + load[s], held[k] + 1
    return Counter((d, size(t), zlib.crc32((t or "").encode()), s, owner[s]) for s, (d, t) in zip(slot, rows)), total


def test_sharding(spark, odd, none, docs, tmp_path):
    for k, df in enumerate((odd, docs)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        placed, used = sharding.shard(df, 5, slots=512, maps=str(tmp_path / f"map{k}"))
        got = placed.collect()
        want, total = shards_by_hand(rows, 5, 512)
        assert Counter((r.doc_id, r.size, r.text_crc32, r.vslot, r.shard) for r in got) == want
        by = defaultdict(list)
        for r in sorted(got, key=lambda r: (r.shard, r.slot)):
            by[r.shard].append((r.slot, r.vslot))
        assert all([x for x, _ in v] == list(range(len(v))) and [x for _, x in v] == sorted(x for _, x in v) for v in by.values())
    maps = str(tmp_path / "map1")
    assert max(total) - min(total) < 0.05 * sum(total) / 5 and sharding.SlotMap.load(spark, maps) == used and used.version == 1
    # A stored map is used again, and edited when the number of shards changes.
    assert sharding.shard(docs, 5, slots=512, maps=maps)[1] == used
    moved, more = sharding.shard(docs, 6, slots=512, maps=maps)
    loads, _ = sharding.slot_loads(sharding.slotted(docs, slots=512), 512)
    total = lambda m: [sum(x for x, o in zip(loads, m.owner) if o == s) for s in range(m.shards)]
    assert more.version == 2 and more == sharding.rebalance(used, loads, 6) and moved.count() == docs.count()
    assert max(total(more)) < 1.2 * sum(loads) / 6 and sum(a != b for a, b in zip(used.owner, more.owner)) < 512 / 3
    assert max(sharding.shard(docs, 4, slots=512, maps=maps)[1].owner) == 3
    assert sharding.SlotMap.load(spark, maps, 1) == used and sharding.SlotMap.load(spark, maps, 2) == more and sharding.SlotMap.latest(spark, maps).version == 3
    assert sharding.shard(none, 5)[0].count() == 0 and sharding.SlotMap.latest(spark, str(tmp_path / "no map")) is None


# --- 5 ---


def leaks_by_hand(items, text):
    """{(item_id, score)} by BM25 from its formula, over every window, given all (item_id, text) of the benchmark."""
    bag = [(i, re.findall(r"\w+", t.lower()), t) for i, t in items if t and i is not None and re.findall(r"\w+", t.lower())]
    if not bag:
        return set()
    n, mean, longest = len(bag), sum(len(b) for _, b, _ in bag) / len(bag), max(len(b) for _, b, _ in bag)
    df = Counter(t for _, b, _ in bag for t in set(b))
    idf = {t: math.log(1 + (n - x + 0.5) / (x + 0.5)) for t, x in df.items()}
    w, half, best = re.findall(r"\w+", (text or "").lower()), max(32, longest), {}
    for s in range(0, max(1, len(w) - half), half):
        window = w[s : s + 2 * half]
        there, five = set(window), {}
        for i, b, t in bag:
            raw = {x: idf[x] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(b) / mean)) for x, c in Counter(b).items()}
            score = sum(v for x, v in raw.items() if x in there) / sum(raw.values())
            if score < 0.6 - 1e-9:
                continue
            ends = [m.end() for m in re.finditer(r"[.!?\n]\s*(?=\S)", t.strip())]
            parts = [re.findall(r"\w+", x.lower()) for x in ((t.strip()[: ends[-1]], t.strip()[ends[-1] :]) if ends else ("", t))]
            question, answer = (parts[0], parts[1]) if parts[0] else (parts[1], [])
            size = min(5, len(question))
            grams = lambda of: {tuple(of[k : k + size]) for k in range(len(of) - size + 1)} or {tuple(of)}  # noqa: E731, B023
            own = grams(question)
            q = len(own & (five.setdefault(size, grams(window)))) / len(own)
            a = len(set(answer) & there) / len(set(answer)) if answer else 1.0
            if q >= 0.8 and a >= 0.8:
                best[i] = max(best.get(i, (0, 0, 0)), (q, a, score))
    return {(i, round(x, 7)) for i, (_, _, x) in best.items()}


def test_decontamination(spark, docs, odd, none, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    every = [(r.item_id, r.text) for r in items.collect()]
    want = {r.doc_id: leaks_by_hand(every, r.text) for r in docs.collect()}

    def found(df, of):
        got = defaultdict(set)
        for r in decontam.contaminated(df, of).collect():
            got[r.doc_id].add((r.item_id, round(r.score, 7)))
        return got

    got = found(docs, items)
    assert got and all(got.get(d, set()) == x for d, x in want.items())
    planted = items.where("length(text) > 60").select((F.col("item_id") + 1000).alias("doc_id"), F.concat(F.lit("Some words before. "), "text", F.lit(" and after.")).alias("text"))
    assert {(r.doc_id - 1000,) * 2 for r in planted.collect()} <= {(r.doc_id - 1000, r.item_id) for r in decontam.contaminated(planted, items).collect()}
    assert decontam.clean(docs, items).count() == docs.count() - len(got)
    assert decontam.contaminated(odd, items).count() == 0 and decontam.clean(odd, items).count() == len(odd_rows()) and decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0 and decontam.clean(odd.withColumn("query", F.lit(1)), items.limit(0)).count() == len(odd_rows())
    holes = spark.createDataFrame([(1, None), (None, "x y z"), (2, "..."), (3, "one"), (3, "one")], "item_id bigint, text string")
    assert {r.item_id for r in decontam.contaminated(spark.createDataFrame([(1, "one two")], "doc_id int, text string"), holes).collect()} == {3}
    # Blocks of the index change nothing.
    monkeypatch.setattr(decontam, "MAX_ITEMS", max(2, len(every) // 3))
    assert found(docs, items) == got and decontam.clean(docs, items).count() == docs.count() - len(got)


def test_wand_equals_full_scores(monkeypatch):
    rng = random.Random(3)
    index = decontam.Index([(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(5, 40)))) for i in range(300)])
    for threshold in (0.02, 0.1, 0.3):
        for _ in range(150):
            terms = sorted({rng.randrange(1, len(index.terms) + 1) for _ in range(60)})
            score = Counter()
            for t in terms:
                for i, x in zip(index.postings[t].items, index.postings[t].impacts):
                    score[i] += x
            assert {i: round(x, 9) for i, x in index.search(terms, threshold)} == {i: round(x, 9) for i, x in score.items() if x >= threshold}
    text = " ".join(rng.choice(list(index.terms)) for _ in range(3000))
    whole = index.leaks(text, 0.3, 0.0)
    monkeypatch.setattr(decontam, "CELLS", 3)
    assert index.leaks(text, 0.3, 0.0) == whole and whole


# --- 6 ---


def test_backoff_lm_on_odd_rows(odd, none):
    # The weights are held against brute force in test_whole_lm.
    got = Counter((r.doc_id, r.n_tokens) for r in ngram_lm.score(odd).collect())
    assert got == Counter((r.doc_id, len(words(r.text)) + 1) for r in odd.collect())
    assert ngram_lm.score(none).count() == 0


# --- 7 ---


def judged_by_hand(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fit = [(len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")


def test_urls(spark, monkeypatch):
    urls = [None, "", "x", "http://COM/en/a", "http://xcom/en/", "ftp://a.example.com/en/71?x", "http://com?/en/", "http://a.b.example.net/de/8#f", "http://example.net/de/9", "https://org/es/", "https://org/es", "a://b://com/en/", "http://" + "s." * 50 + "com/en/" + "p" * 5000, "http://é.com/en/ü"]
    pages = spark.createDataFrame([(i, u, u) for i, u in enumerate([*urls, urls[3]])], "page_id int, url string, host string")
    real = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").cast("int"), "url", F.lit("z").alias("host"))
    df = pages.unionAll(real)
    want = Counter((r.page_id, *judged_by_hand(r.url, queries.URL_RULES)) for r in df.collect())
    assert Counter(tuple(r) for r in urlfilter.judge(df, queries.URL_RULES).collect()) == want
    monkeypatch.setattr(urlfilter, "MAX_INDEX_BYTES", 1)
    assert Counter(tuple(r) for r in urlfilter.judge(df, queries.URL_RULES).collect()) == want
    assert urlfilter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_colliding_digests(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: 5)
    (tmp_path / "i").write_bytes(urlfilter.Index.build([("block", "a", "/x"), ("allow", "b", "/y"), ("block", "c", "")]))
    index = urlfilter.Index(str(tmp_path / "i"))
    found = index.find([b"b/y", b"nope", b"c"])
    assert index.allow[found[0]] == 1 and found[1] == -1 and index.allow[found[2]] == 0


# --- 8 ---

KEY = "AKIA" + "Q7ZT" * 4


def spans_by_hand(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, docs, odd, none):
    live, copied = "Zx9Qw8Er7Ty6Ui5Op4As", "Example0Example1Key2abc3"
    texts = [f"é {KEY} and Token: '{'a1' * 14}' {live}", f"PASSWORD=short1 api_key = abcdef secret=token=abcdefgh {copied} AKIAAKIA", f"x {copied} \u017fecret=abcdef api\u212aey=abcdef", f"{copied} {live}", "passwd:abc token:'' secret  =  \"q.w-e_r/t+y\"", "f" * 23 + " " + "0" * 24 + "g"]
    more = spark.createDataFrame([(1_000_000 + i, t, "en", f"s{i}", 0) for i, t in enumerate(texts)], DOCS).withColumn("row", F.lit("x")).withColumn("quality", F.lit(1))
    df = odd.unionAll(more).unionAll(docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint")).withColumn("row", F.lit("x")).withColumn("quality", F.lit(1)))
    text_of = Counter()
    for r in df.collect():
        s = spans_by_hand(r.text)
        base = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in s)
        text_of[r.doc_id, *(sum(k == j for _, k, _ in s) for j in range(3)), hashlib.sha256(base.encode()).hexdigest()] += 1
    got = secret_scan.digest(secret_scan.secrets(df)).collect()
    assert Counter(tuple(r)[:5] for r in got) == text_of
    owned = {(r.doc_id, x) for r in got for x in r.spans.split(",") if x.startswith("owned")}
    at = lambda i, v: (1_000_000 + i, f"owned:{texts[i].index(v)}:{texts[i].index(v) + len(v)}")
    assert {at(0, live), at(3, live)} <= owned and not any(at(i, copied) in owned for i in (1, 2, 3))
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    by = {r.doc_id - 1_000_000: r for r in clean.where("doc_id >= 1000000").collect()}
    assert by[0].text == "é [secret] and [secret]' [secret]" and by[0].n_chars == len(by[0].text) and copied in by[2].text
    assert secret_scan.digest(secret_scan.secrets(none)).count() == 0 and secret_scan.redact(none).count() == 0


def test_redaction_by_row(spark):
    live, copied = "Zx9Qw8Er7Ty6Ui5Op4As", "Example0Example1Key2abc3"
    names = ("key", "__key", "__spans", "found", "live", "row", "spans", "h")
    rows = [(k % 3, f"{live} is of s{k % 2} and {copied} of all", f"s{k % 12}" if k % 2 else "s0") for k in range(40)] + [(1, None, None), (None, f"password=abcdefg {copied}", "s1"), (None, "", "s1")]
    rows += [(7, f"Yy8Kp3Lm9Rt2Q7q6W5w4E3 twice", "s5")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({n: F.lit("x") for n in names}).repartition(4)
    clean = secret_scan.redact(df)
    owners = defaultdict(set)
    for _, t, s in rows:
        for v in re.findall(r"[A-Za-z0-9]{20,}", t or ""):
            owners[v].add(s or "")
    few = max(1, min(2, int(0.1 * len({s for _, _, s in rows}))))
    mask = lambda t: t and re.sub(r"password=\w+", "[secret]", re.sub(r"[A-Za-z0-9]{20,}", lambda m: "[secret]" if len(owners[m[0]]) <= few else m[0], t))
    assert clean.columns == df.columns and Counter((r.doc_id, r.text, r.source) for r in clean.collect()) == Counter((d, mask(t), s) for d, t, s in rows)


def test_urls_of_very_many_labels(spark, monkeypatch):
    long = "a." * 100_000
    rows = [(1, f"http://{long}example.com/en/7"), (2, f"http://{long}com/en/"), (3, f"http://{long}org/" + "x" * 100_000), (4, "http://xcom/en/"), (5, "http://com./en/"), (6, "http://net/de/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({c: F.lit(7) for c in ("rule", "__row", "short", "h", "n")})
    want = {1: "example.com/en/7", 2: "com/en/", 3: None, 4: None, 5: None, 6: "net/"}
    rules = [*queries.URL_RULES, ("block", "net", "/")]
    want[6] = "net/de/"
    for _ in range(2):
        began = time.perf_counter()
        got = urlfilter.judge(df, rules, keep=("page_id", "rule", "__row", "short"))
        assert {r.page_id: r.rule for r in got.collect()} == want and got.columns == ["page_id", "__row", "short", "host", "path", "rule", "verdict"]
        assert time.perf_counter() - began < 30
        monkeypatch.setattr(urlfilter, "MAX_INDEX_BYTES", 1)


def test_scan_of_many_candidates():
    text = " ".join(f"token=abcdef{i} Zx9Qw8Er7Ty6Ui5Op{i:06d} {'ab' * 12}" for i in range(30_000))
    began = time.perf_counter()
    found = secret_scan.scan(text)
    assert len(found) == 90_000 and time.perf_counter() - began < 20


# --- 9 ---


def test_toxicity(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(toxicity.training_rows(d, labels))
    scored = toxicity.score(d, model).withColumn("h", toxicity.held_out()).join(labels, "doc_id").where("h").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in scored)
    y, s = np.array([r.toxic for r in scored]), np.array([r.score for r in scored])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    hit = (s >= toxicity.THRESHOLD) & (y == 1)
    assert auc > 0.97 and hit.sum() > 0.85 * y.sum() and hit.sum() > 0.75 * (s >= toxicity.THRESHOLD).sum()
    got = toxicity.score(odd, model, keep=("doc_id", "text"), sentences=True)
    assert got.count() == len(odd_rows()) and got.where("score between 0 and 1").count() == len(odd_rows())
    bad = spark.createDataFrame([(1, "The weather is fine today. You are a stupid worthless idiot and a moron! It rains.")], "doc_id int, text string")
    r = toxicity.score(bad, model, sentences=True).first()
    assert r.score > 0.5 and "stupid" in bad.first().text[r.offending[0].start : r.offending[0].end] and len(r.offending) == 1
    assert toxicity.score(none, model).count() == 0
    for rows in ([], [("a", 0)], [("a", 1)]):
        assert 0 <= toxicity.train(rows).score(None) <= 1


def noisy_or_by_hand(bias, weights, text):
    """From the weights alone: each sentence's words and prefixes, then the noisy-or with a leak."""
    sigma = lambda z: 1 / (1 + math.exp(-z))
    clean = 1 - sigma(bias)
    for s in re.split(r"[.!?\n]+", text or ""):
        of = [f for w in set(re.findall(r"\w+", s.lower())) for f in [w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) > n)]]
        z = bias + sum(weights.get(f, 0.0) for f in of)
        clean *= min(1.0, (1 - sigma(z)) / (1 - sigma(bias)))
    return 1 - clean


def test_noisy_or(docs, odd, spark):
    m = toxicity.Model(-2.0, {"bad": 3.0, "good": -1.0})
    leak, p = 1 / (1 + math.exp(2)), 1 / (1 + math.exp(-1))
    score, found = m.read("Good. bad bad! Fine. BAD")
    assert score == pytest.approx(1 - (1 - leak) * ((1 - p) / (1 - leak)) ** 2) and [(a, b) for a, b, _ in found] == [(5, 13), (20, 24)]
    assert [s for _, _, s in found] == pytest.approx([p, p]) and m.score("Good. Fine. " * 10_000) == m.score(None) == pytest.approx(leak)
    model = toxicity.train(toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    for df in (docs, odd):
        text = Counter((r.doc_id, round(noisy_or_by_hand(model.bias, model.weights, r.text), 6)) for r in df.collect())
        assert Counter((r.doc_id, round(r.score, 6)) for r in toxicity.score(df, model).collect()) == text


def test_gradient():
    rng = np.random.default_rng(3)
    document = np.sort(rng.integers(0, 12, 40))
    sentence, column = rng.integers(0, 40, 120), rng.integers(0, 6, 120)
    y, gain, w = rng.integers(0, 2, 12).astype(float), rng.random(12) + 0.5, np.append(rng.normal(0, 1, 6), -1.5)

    def loss(w):
        sigma = lambda z: 1 / (1 + np.exp(-z))
        out = 0.0
        for d in range(12):
            keep = 1 - sigma(w[-1])
            for s in np.flatnonzero(document == d):
                keep *= min(1.0, (1 - sigma(w[-1] + w[column[sentence == s]].sum())) / (1 - sigma(w[-1])))
            out -= gain[d] * math.log(1 - keep if y[d] else keep)
        return out / 12

    got = toxicity.gradient(w, column, sentence, document, y, gain)
    for k in range(7):
        step = np.eye(7)[k] * 1e-6
        assert got[k] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-5)


# --- 10 ---


def test_extraction_equals_the_article(spark):
    d = spark.read.parquet(f"{SF}/pages.parquet")
    page = {r.page_id: r for r in d.collect()}
    got = html_main.extract(d).collect()
    assert len(got) == len(page)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", page[r.page_id].html, re.S)[1]
        want = html.unescape(re.sub(r"</?b>", "", re.sub(r"<(p|br|h1|/h1|/p)>", " ", inner)))
        assert r.text == " ".join(want.split()) and r.n_chars == len(r.text) and r.url == page[r.page_id].url


def test_differencing_deletes_shared_lines(spark):
    def body(*own):
        return "<html><head><title>t</title></head><body><table><tr><td>Site name</td></tr><tr><td>Links here</td></tr></table>" + "".join(f"<p>{x}" for x in own) + "<p>All rights reserved<script>x('</p>')</script></body></html>"

    rows = [(1, "http://h/a/1", body("Alpha &lt;one&gt;", "more  \n of it")), (2, "http://h/a/2", body("Beta<b>two</b>")), (3, "http://other/x", body("Gamma")), (4, "http://h/a/1", None), (None, None, ""), (3, "http://other/x", body("Gamma"))]
    rows += [(6, "http://h2/1", f"<article>{'long ' * 20000}</article>"), (7, "http://h2/2", f"<article>{'long ' * 20000}</article><p>x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("shared", F.lit(1)).withColumn("key", F.lit(2))
    got = Counter((r.page_id, r.text) for r in html_main.extract(df).collect())
    assert got[1, "Alpha <one> more of it"] == 1 and got[2, "Betatwo"] == 1 and got[4, ""] == 1 and got[None, ""] == 1
    assert got[3, "Site name Links here Gamma All rights reserved"] == 2
    # A line of its own beside an article stays: nothing says it isn't main text.
    assert got[6, " ".join(["long"] * 20000)] == got[7, " ".join([*["long"] * 20000, "x"])] == 1
    assert html_main.extract(df.limit(0)).count() == 0


def test_landmarks():
    page = "<body><header><h1>Site</h1></header><nav>a<li>b</nav><div class='cookie-notice'>c</div><main><article><header><h1>Title</h1><p>by x</header><p>One &amp; <b>t</b>wo<aside>s</aside><p class=ad>x<p>Three&nbsp;3<!-- c --><form><p>f</form></article><section id=comments><p>no</section></main><footer>f</footer>"
    assert html_main.main_text(page) == "Title One & two Three 3"
    for bad in ("<", "<p", "<!--", "</p>", "<a 'x>", "<script>", "a<b", "<p class=\"x>y", "&amp", "<div>" * 3000):
        html_main.main_text(bad)


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert html_main.shared_lines(np.array(a), np.array(b)).sum() == best[-1][-1]


# --- the pipeline ---


def test_pipeline(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        kept[name] = now.collect()
        now = spark.createDataFrame(kept[name], now.schema)
        assert name == names[-1] or now.columns == docs.columns
    model = toxicity.train(toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    every = docs.collect()
    fine = [r for r in every if noisy_or_by_hand(model.bias, model.weights, r.text) < corpus_pipeline.REJECT]
    assert {r.doc_id for r in kept["toxicity"]} == {r.doc_id for r in fine}
    assert {r.doc_id for r in kept["near_duplicates"]} == kept_by_hand([(r.doc_id, r.text) for r in fine])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [r for r in kept["near_duplicates"] if not leaks_by_hand(items, r.text)]
    assert {r.doc_id for r in kept["decontamination"]} == {r.doc_id for r in left}
    assert not any(spans_by_hand(r.text) for r in kept["secrets"]) and len(kept["secrets"]) == len(left)
    mine = bpe.Bpe(open(queries.tokenizer_path(), "rb").read())
    text = {r.doc_id: r.text for r in kept["secrets"]}
    for r in kept["tokens"]:
        assert "".join(bpe.decode(mine, [mine.pack(r.ids)])) == text[r.doc_id] and r.n_tokens == len(r.ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(text)


def test_pipeline_on_odd_rows(spark, odd, none):
    clash = {n: F.lit("x") for n in ("score", "ids", "fp", "toxicity", "__toxicity", "encode", "query", "kept", "mark", "root", "set", "keys", "found", "live", "__key", "__spans")}
    for given, left in ((odd.withColumns(clash), 6), (none, 0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            assert name == "tokens" or now.columns == given.columns
            now = spark.createDataFrame(now.collect(), now.schema)
        assert now.count() == left

"""Byte-pair encoding and decoding as streaming transducers with constant memory.

Merging in rank order only ever removes boundaries, and whether the boundary
before a right operand v goes is settled by v's own bytes and by whether a
better-ranked rule takes a suffix token of v rightwards first.  Chains of such
rules have falling ranks, so the longest one that starts from a left operand,
in bytes, is that operand's reach, and the longest of all the merge list's
sufficient lookahead: a boundary with as many bytes after it as the operands
that may end there reach is final, whatever follows.  Every word goes through
the encoder in pieces of STEP bytes; it emits the tokens before the last final
boundary and keeps the rest.  Splitting into words before merging has a
lookahead of a few characters of its own.

The decoder turns ids into bytes and bytes into text with an incremental
UTF-8 state machine; malformed bytes become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dieflow.llm.common import Shared, fresh, map_batches

#: Fixed value: the word split of the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The rest of a run that is too long to hold, by its class.
RUNS = {"L": r"\p{L}+", "N": r"\p{N}+", "O": r"[^\s\p{L}\p{N}]+", "S": r"\s+(?!\S)|\s+"}
#: Characters after a word that settle it: the longest contraction and one to see a run end.
SPLIT_LOOKAHEAD = 4
BLOCK = 1 << 16
MAX_MODEL_BYTES = 64 << 20
#: Bytes of a word fed at a time; shorter words are one piece.
STEP = 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Words(dict):
    """Packed ids by word, filled on demand.

    When full it becomes the older generation, from which words in use come
    back; so memory stays bounded and frequent words stay known.
    """

    def __init__(self, bpe: Bpe, limit: int = 1 << 17) -> None:
        super().__init__()
        self.bpe, self.limit = bpe, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or WordStream(self.bpe).whole(word.encode())
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """A merge list, from the JSON of a byte-level BPE tokenizer file."""

    def __init__(self, data: bytes) -> None:
        given = json.loads(data)
        model = given["model"]
        if model["type"] != "BPE" or (given["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE tokenizer")
        if given["normalizer"] or given["pre_tokenizer"]["add_prefix_space"] or not given["pre_tokenizer"]["use_regex"]:
            raise ValueError("normalizers, prefix spaces and other word splits are not supported")
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.ids = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rules = [tuple(bytes(back[c] for c in side) for side in pair) for pair in pairs]
        self.rank = {(self.ids[u], self.ids[v]): r for r, (u, v) in reversed([*enumerate(self.rules)])}
        self.made = [self.ids[u + v] for u, v in self.rules]
        self.byte_ids = [self.ids.get(bytes([b])) for b in range(256)]
        n = max([*self.ids.values(), *self.special.values()]) + 1
        table = [b""] * n
        for t, i in self.ids.items():
            table[i] = t
        for t, i in self.special.items():
            table[i] = t.encode()
        self.table = table
        self.lengths = np.array([len(t) for t in table], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.sizes = self.lengths.tolist()
        self.reach = self._reaches()
        self.lookahead, self.longest = max(self.reach.values(), default=0), max(map(len, self.reach), default=0)
        self.split, self.runs = regex.compile(SPLIT), {k: regex.compile(p) for k, p in RUNS.items()}
        self.words = Words(self)

    def _reaches(self) -> dict[bytes, int]:
        """By left operand, the bytes after it that settle whether a rule takes it: the longest chain of rules of falling rank, each of which may keep the one before from applying."""
        made = {u + v: v for u, v in reversed(self.rules)}
        reach: dict[bytes, int] = {}
        for u, v in self.rules:
            far, t = 0, v
            while t is not None:
                far = max(far, reach.get(t, 0))
                t = made.get(t)
            reach[u] = max(reach.get(u, 0), len(v) + far)
        return reach

    def settled(self, held: bytes, ids: list[int]) -> tuple[int, int]:
        """How many of held's tokens, and of its bytes, lie before the last boundary that no byte to come can remove."""
        get, end = self.reach.get, len(held)
        for n in range(len(ids) - 1, 0, -1):
            end -= self.sizes[ids[n]]
            after = len(held) - end
            if after >= self.lookahead or all(get(held[end - k : end], 0) <= after for k in range(1, min(end, self.longest) + 1)):
                return n, end
        return 0, 0

    @staticmethod
    def pack(ids: Iterable[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, of any length."""
        if len(word) > 64:
            return self._merge_long(word)
        ids = [self.byte_ids[b] for b in word]
        none = len(self.made)
        get, made = self.rank.get, self.made
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        n = len(word)
        ids: list[int | None] = [self.byte_ids[b] for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.rank.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = self.made[rank], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x is not None]


class WordStream:
    """Encodes one word given in pieces; holds no more than twice the lookahead, a token and a piece."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.held, self.due = bpe, b"", STEP

    def feed(self, piece: bytes) -> bytes:
        self.held += piece
        if len(self.held) < self.due:
            return b""
        ids = self.bpe.merge(self.held)
        n, end = self.bpe.settled(self.held, ids)
        self.held = self.held[end:]
        # What isn't settled is merged again once there is as much more of it, or enough for any rule.
        self.due = len(self.held) + max(STEP, min(len(self.held), self.bpe.lookahead))
        return self.bpe.pack(ids[:n])

    def finish(self) -> bytes:
        ids, self.held, self.due = self.bpe.merge(self.held) if self.held else [], b"", STEP
        return self.bpe.pack(ids)

    def whole(self, word: bytes) -> bytes:
        """All of a word, fed in pieces."""
        if len(word) < STEP:
            return self.feed(word) + self.finish()
        return b"".join([*(self.feed(word[at : at + STEP]) for at in range(0, len(word), STEP)), self.finish()])


class Encoder:
    """Text in pieces of any size to packed little-endian 32-bit ids."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.held = bpe, ""
        self.word: WordStream | None = None
        self.run = ""

    def feed(self, piece: str) -> bytes:
        out, text = [], self.held + piece
        while found := min(((at, s) for s in self.bpe.special if (at := text.find(s)) >= 0), default=None):
            at, special = found
            out += [self._split(text[:at], True), self.bpe.pack([self.bpe.special[special]])]
            text = text[at + len(special) :]
        tail = max((k for s in self.bpe.special for k in range(len(s) - 1, 0, -1) if text.endswith(s[:k])), default=0)
        cut = len(text) - tail
        out.append(self._split(text[:cut], False))
        self.held += text[cut:]
        return b"".join(out)

    def finish(self) -> bytes:
        out, self.held = self._split(self.held, True), ""
        return out

    def _split(self, text: str, last: bool) -> bytes:
        """Encodes what is settled of text and leaves the rest in held."""
        out = []
        if self.word:
            m = self.bpe.runs[self.run].match(text)
            end = m.end() if m else 0
            if not last and len(text) - end < SPLIT_LOOKAHEAD:
                cut = max(0, end - 2 * SPLIT_LOOKAHEAD)
                self.held = text[cut:]
                return self.word.feed(text[:cut].encode())
            out += [self.word.feed(text[:end].encode()), self.word.finish()]
            self.word, text = None, text[end:]
        words, tail = self.bpe.split.findall(text), ""
        while not last and words and len(tail) < SPLIT_LOOKAHEAD:
            tail = words.pop() + tail
        out.append(b"".join(map(self.bpe.words.__getitem__, words)))
        if len(tail) > BLOCK and (cut := self.bpe.split.match(tail).end() - 2 * SPLIT_LOOKAHEAD) > BLOCK // 2:
            # One run fills what is held: open it as a word in pieces.
            inner = tail[cut - 1]
            self.run = next(k for k in "LNSO" if self.bpe.runs[k].match(inner))
            self.word = WordStream(self.bpe)
            out.append(self.word.feed(tail[:cut].encode()))
            tail = tail[cut:]
        self.held = tail
        return b"".join(out)


class Decoder:
    """Packed ids in pieces to text."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.state = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes, last: bool = False) -> str:
        ids = np.frombuffer(packed, dtype="<u4")
        sizes = self.bpe.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.bpe.starts[ids] - (ends - sizes), sizes)
        return self.state.decode(self.bpe.flat[at].tobytes(), last)


def pieces(text: str, size: int = BLOCK) -> Iterator[str]:
    for at in range(0, len(text), size):
        yield text[at : at + size]


def encode(bpe: Bpe, texts: Iterable[str]) -> Iterator[bytes]:
    """Packed ids of a text given in pieces, as soon as they are settled."""
    encoder = Encoder(bpe)
    for piece in texts:
        yield encoder.feed(piece)
    yield encoder.finish()


def decode(bpe: Bpe, packed: Iterable[bytes]) -> Iterator[str]:
    decoder = Decoder(bpe)
    for piece in packed:
        yield decoder.feed(piece)
    yield decoder.feed(b"", True)


def _shared(docs: DataFrame, path: str) -> Shared:
    """The tokenizer file's content, sent to the executors: a vocabulary, whose size is checked and doesn't follow the data."""
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is over {MAX_MODEL_BYTES} bytes")
    return Shared(docs.sparkSession, data)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs plus `ids`, an array of long token ids; null texts encode as empty.  An existing column of that name is replaced; repeated rows stay."""
    shared = _shared(docs, path)
    kept = docs.drop(ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = shared.build(Bpe)
        out = [np.frombuffer(b"".join(encode(bpe, pieces(t or ""))), dtype="<u4").astype(np.int64) for t in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], ids])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(kept.withColumn(*fresh(kept, "encode"), F.col(text).cast("string")), run, f"{schema}, `{ids}` array<bigint>")


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs plus `text`, decoded from an array of token ids; null ids decode as empty, repeated rows stay."""
    shared = _shared(docs, path)
    kept = docs.drop(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = shared.build(Bpe)
        out = ["".join(decode(bpe, [bpe.pack(x or [])])) for x in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(kept.withColumn(*fresh(kept, "decode"), F.col(ids)), run, f"{schema}, `{text}` string")


def digest_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded piece by piece; with_ids adds the ids.

    Null texts count as empty.  Repeated rows stay.  Without the ids, neither
    they nor the decoded text of a document are ever held whole.
    """
    shared = _shared(docs, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = shared.build(Bpe)
        rows = []
        for t in batch.column(1).to_pylist():
            n, ids, texts, decoder, held = 0, hashlib.sha256(), hashlib.sha256(), Decoder(bpe), []
            for packed in encode(bpe, pieces(t or "")):
                n += len(packed) // 4
                ids.update(packed)
                texts.update(decoder.feed(packed).encode())
                if with_ids:
                    held.append(packed)
            texts.update(decoder.feed(b"", True).encode())
            rows.append((n, ids.hexdigest(), texts.hexdigest(), np.frombuffer(b"".join(held), dtype="<u4").astype(np.int32)))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))[: len(names) - 1])]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(given, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash cuts every text into chunks where its last 32 bytes say so, so that equal passages of different
documents are cut alike.  Chunks that occur in several places are encoded once:

1. count the chunks' hashes; those that occur twice or more go into a membership map of fixed size;
2. chunks that the map may hold are brought together by digest and encoded, once each;
3. documents without such chunks are encoded where they are read;
4. the others, once for each distinct text, meet the tokens of their shared chunks.  What lies between is encoded there, and the
   chunk joins are repaired.

A chunk's tokens next to a join may be wrong, since the join may cut a word.  The repair takes the text from the
last safe place before the join to the first one after it and encodes it anew; it widens to the left until the tokens that it
replaces are exactly the encoding of the text that it replaces.  A safe place is a lone space between two non-blanks: a new
piece begins there in any context.

Tokens come from ``tiktoken`` with the vocabulary and merge order of the tokenizer file, which gives what the
``tokenizers`` library gives (tests hold them against each other).

Edge cases: a null text is an empty one with no tokens; very long texts are cut like others; repeated rows get
the same answer; a null ``doc_id`` stays; an empty table gives an empty result; extra columns are ignored.
Ties don't occur: a text has one encoding.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BITS, membership, ship, text_of

ship(__name__)

# Fixed value: how byte-level BPE cuts text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks are cut once in 2^CUT_BITS bytes on average, and have so many bytes, but for the last.
CUT_BITS, SHORTEST, LONGEST = 9, 128, 8192
#: Slices of the membership map, 16 MiB.
SLICES = 4096


def _gear() -> np.ndarray:
    """256 mixed numbers, by the splitmix64 rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks of a text's UTF-8 bytes; none cuts a character."""
    if len(data) <= SHORTEST:
        return [data] if data else []
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for step in (1, 2, 4, 8, 16):  # h[i]: of the 32 bytes up to i, each shifted by its distance
        moved = h.copy()
        moved[step:] += h[:-step] << np.uint32(step)
        h = moved
    cut = (h >> np.uint32(32 - CUT_BITS)) == 0
    cut[:-1] &= (raw[1:] & 0xC0) != 0x80
    out, start = [], 0
    for end in [*(np.flatnonzero(cut) + 1).tolist(), len(data)]:
        while end - start > LONGEST:
            forced = start + LONGEST
            while forced > start + 1 and data[forced] & 0xC0 == 0x80:
                forced -= 1
            out.append(data[start:forced])
            start = forced
        if end - start >= SHORTEST or end == len(data):
            if end > start:
                out.append(data[start:end])
            start = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def number(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


class Coder:
    """Encodes and decodes by the contents of a tokenizer file."""

    def __init__(self, contents: str):
        import tiktoken

        spec = json.loads(contents)
        ranks = {_bytes_of(t): i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {b: i for b, i in ranks.items() if i not in set(special.values())}
        self.coding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = any(c.isspace() for s in special for c in s)
        assert not self.special, "a special token with blanks would need other safe places"

    def encode(self, text: str) -> np.ndarray:
        return self.coding.encode_to_numpy(text, allowed_special="all").astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.coding.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def _bytes_of(token: str) -> bytes:
    return bytes(_CHARACTERS[c] if c in _CHARACTERS else 0 for c in token) if all(c in _CHARACTERS for c in token) else token.encode()


def _characters() -> dict[str, int]:
    """How byte-level tokenizers write bytes: printable Latin-1 as itself, the rest from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


_CHARACTERS = _characters()
_CODERS: dict[int, Coder] = {}


def safe_after(text: str) -> int:
    """The first safe place in a text after its first character, or -1."""
    at = text.find(" ", 1)
    while 0 <= at < len(text) - 1:
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at = text.find(" ", at + 1)
    return -1


def safe_before(text: str, end: int) -> int:
    """The last safe place in ``text[:end]``, or 0."""
    at = text.rfind(" ", 0, max(0, end - 1))
    while at > 0:
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at = text.rfind(" ", 0, at)
    return 0


def assemble(parts: list[tuple[str, np.ndarray]], coder: Coder) -> np.ndarray:
    """Tokens of the parts' whole text, from the tokens of each.

    Pieces without a safe place wait, and are encoded once, with what surrounds them; so the time is that of the text's length."""
    done: list[np.ndarray] = []  # tokens of what lies before ``text``
    text, ids = "", np.empty(0, "<u4")  # the last stretch, and its tokens
    waiting: list[str] = []  # pieces after it without a safe place

    def join(more: str) -> None:
        """The last stretch goes, up to where its tokens agree with those of its end alone; that end is encoded with what follows."""
        at = len(text)
        while True:
            at = safe_before(text, at)
            old = coder.encode(text[at:])
            if at == 0 or np.array_equal(ids[len(ids) - len(old):], old):
                break
        done.append(ids[: len(ids) - len(old)] if at else ids[:0])
        done.append(coder.encode("".join([text[at:], *waiting, more])))
        waiting.clear()

    for piece, own in parts:
        if not text:
            text, ids = piece, own
            continue
        after = safe_after(piece)
        if after < 0:
            waiting.append(piece)
            continue
        gone = coder.encode(piece[:after])
        assert np.array_equal(own[: len(gone)], gone)
        join(piece[:after])
        text, ids = piece[after:], own[len(gone):]
    if waiting:
        join("")
        ids = ids[:0]
    return np.concatenate([*done, ids])


def _result(ids: np.ndarray, coder: Coder) -> tuple[int, str, str]:
    text = coder.decode(ids)
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _coder(held) -> Coder:
    contents = held.value
    key = hash(contents)
    if key not in _CODERS:
        _CODERS[key] = Coder(contents)
    return _CODERS[key]


def _maybe(bits: bytes, key: int) -> bool:
    place = key % (SLICES * SLICE_BITS)
    return bool(bits[place >> 3] >> (place & 7) & 1)


RESULT = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each document: number and digest of its tokens, and digest of the text decoded from them."""
    spark = docs.sparkSession
    contents = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.md5(text_of()).alias("key"), text_of().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0):
                seen.update(number(digest(c)) for c in chunks(value.as_buffer().to_pybytes()))
            yield pa.RecordBatch.from_pydict({"h": pa.array(seen.keys(), pa.int64()), "n": pa.array(seen.values(), pa.int64())})

    counted = docs.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    bits = bytearray(SLICES * SLICE_BITS // 8)
    for r in membership(F.col("h"), counted.filter("n > 1").select("h"), SLICES).collect():  # at most SLICES rows of 4 KiB
        bits[r["slice"] * SLICE_BITS // 8 : (r["slice"] + 1) * SLICE_BITS // 8] = r["bits"]
    shared = spark.sparkContext.broadcast(bytes(bits))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for value in batch.column(0):
                for c in chunks(value.as_buffer().to_pybytes()):
                    k = digest(c)
                    if _maybe(shared.value, number(k)):
                        found[k] = c
            yield pa.RecordBatch.from_pydict({"k": pa.array(found.keys(), pa.binary()), "chunk": pa.array(found.values(), pa.binary())})

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(contents)
        for batch in batches:
            ids = [coder.encode(c.as_py().decode()).tobytes() for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["k", "ids"])

    taken = docs.select("text").mapInArrow(take, "k binary, chunk binary").groupBy("k").agg(F.any_value("chunk").alias("chunk"))
    encoded = taken.mapInArrow(once, "k binary, ids binary")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(contents)
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1)):
                data = value.as_buffer().to_pybytes()
                if not any(_maybe(shared.value, number(digest(c))) for c in chunks(data)):
                    at.append(i)
                    rows.append(_result(coder.encode(data.decode()), coder))
            columns = [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(RESULT)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", *[n for n, _ in RESULT]])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [any(_maybe(shared.value, number(digest(c))) for c in chunks(v.as_buffer().to_pybytes())) for v in batch.column(1)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, ks = [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for i, c in enumerate(chunks(value.as_buffer().to_pybytes())):
                    k = digest(c)
                    if _maybe(shared.value, number(k)):
                        keys.append(key)
                        places.append(i)
                        ks.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(ks, pa.binary())], names=["key", "i", "k"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(contents)
        for batch in batches:
            rows = []
            for value, known in zip(batch.column(1), batch.column(2)):
                own = {x["i"].as_py(): x["ids"].as_buffer() for x in known}
                parts: list[tuple[str, np.ndarray | None]] = []
                for i, c in enumerate(chunks(value.as_buffer().to_pybytes())):
                    if i in own:
                        parts.append((c.decode(), np.frombuffer(own[i], "<u4")))
                    elif parts and parts[-1][1] is None:
                        parts[-1] = (parts[-1][0] + c.decode(), None)
                    else:
                        parts.append((c.decode(), None))
                ids = assemble([(t, coder.encode(t) if x is None else x) for t, x in parts], coder)
                rows.append(_result(ids, coder))
            columns = [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(RESULT)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", *[n for n, _ in RESULT]])

    result = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    lone = docs.select("doc_id", "text").mapInArrow(alone, f"doc_id {id_type}, {result}")
    texts = docs.select("key", "text").mapInArrow(others, "key string, text string").groupBy("key").agg(F.any_value("text").alias("text"))
    refs = texts.mapInArrow(refer, "key string, i int, k binary").join(encoded, "k")
    known = refs.groupBy("key").agg(F.collect_list(F.struct("i", "ids")).alias("known"))
    met = texts.join(known, "key").select("key", "text", "known").mapInArrow(join, f"key string, {result}")
    return lone.unionByName(docs.select("doc_id", "key").join(met, "key").drop("key"))

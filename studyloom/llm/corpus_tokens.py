"""Problem 8: the whole corpus as token ids of a public tokenizer.

Method: content-defined chunk reuse. A rolling hash over the bytes of a text sets chunk ends (at a
character's start), so that texts which share passages share chunks. Equal chunks of all documents meet at one place and
are encoded once; each reference gets the ids. A chunk's ids hold for the document between its first and last safe
place (a non-space before an ASCII space or line feed: no piece of the tokenizer's pattern crosses it, whatever surrounds
it); what lies between the last safe place of one chunk and the first of the next is put together
from the ids' bytes and encoded again, over as many chunks as have no safe place. The result is that of encoding
the whole text.

Scale. One row per chunk and Arrow batch, with its bytes and the list of its references, is shuffled by
the chunk's hash; ids travel as 16-bit numbers (byte_bpe_50k has 50,257) to their document. A chunk which more than a
twentieth of a batch's rows hold (page furniture, empty texts) is hot: its rows spread over `SPREAD` places, at each of which it is encoded
once. Nothing is collected or broadcast but the path of the vocabulary.

Defined results: NULL and empty texts have an empty list; one row comes out for each row of the table, repeated doc_ids
too; special tokens' strings are ordinary text; lone surrogates can't occur in Parquet text; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.session import spread

TOKENIZERS = "/opt/tokenizers"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the vocabulary's pattern
WINDOW, MASK, LEAST, MOST = 24, (1 << 11) - 1, 512, 8192
SPREAD = 32

_LOADED: dict = {}


def encoder(folder: str, name: str = "byte_bpe_50k"):
    """(tiktoken encoding, bytes of each id), once per worker."""
    key = (folder, name)
    if key not in _LOADED:
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        values = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            values[n] = token
        _LOADED[key] = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), values
    return _LOADED[key]


LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def encode(enc, text: str) -> list[int]:
    """Ids of a text. The library's pattern overflows its stack on endless white space, so a long run is taken out: the pattern
    makes it one piece, but for its last character, which goes on with what follows."""
    ids: list[int] = []
    at = 0
    for m in LONG_SPACE.finditer(text):
        last = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc.encode_ordinary(text[at : m.start()])
        ids += enc._encode_single_piece(text[m.start() : last].encode())
        at = last
    return ids + enc.encode_ordinary(text[at:])


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text's UTF-8 bytes, the last one its length."""
    n = len(data)
    if n <= LEAST:
        return [n]
    b = np.frombuffer(data, np.uint8)
    wide = b.astype(np.uint64) + np.uint64(1)
    rolling = np.zeros(n - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            rolling += wide[k : n - WINDOW + 1 + k] * _POWERS[k]
        rolling ^= rolling >> np.uint64(31)
    marks = np.flatnonzero((rolling & np.uint64(MASK)) == 0) + WINDOW
    starts = (b & 0xC0) != 0x80  # a character begins here
    ends, at, m = [], 0, 0
    while n - at > LEAST:
        while m < len(marks) and marks[m] < at + LEAST:
            m += 1
        end = int(marks[m]) if m < len(marks) and marks[m] < at + MOST else at + MOST
        if end >= n:
            break
        while not starts[end]:
            end -= 1
        ends.append(end)
        at = end
    return [*ends, n]


def _pieces(least_hot: int):
    def run(batches):
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        for number, batch in enumerate(batches):
            known: dict[bytes, int] = {}
            chunks: list[bytes] = []
            refs: list[list[dict]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                at = 0
                ends = chunk_ends(data)
                for n, end in enumerate(ends):
                    part = data[at:end]
                    h = xxhash.xxh3_128_digest(part)
                    if h not in known:
                        known[h] = len(chunks)
                        chunks.append(part)
                        refs.append([])
                    refs[known[h]].append((doc, row, n, len(ends)))
                    at = end
                row += 1
            hot = max(least_hot, batch.num_rows // 20)
            flat = [r for group in refs for r in group]
            offsets = np.r_[0, np.cumsum([len(g) for g in refs])].astype(np.int32)
            columns = list(zip(*flat)) if flat else [[], [], [], []]
            struct = pa.StructArray.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int32()),
                    pa.array(columns[3], pa.int32()),
                ],
                ["doc", "row", "seq", "parts"],
            )
            salts = [((row + number) % SPREAD if len(g) > hot else 0) for g in refs]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(known), pa.binary()),
                    pa.array(salts, pa.int32()),
                    pa.array(chunks, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), struct),
                ],
                ["h", "salt", "chunk", "refs"],
            )

    return run


def id_type(vocabulary: int) -> str:
    """The narrowest integer that holds every id of a vocabulary."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _encode(folder: str, name: str):
    """Chunks sorted by hash: each is encoded when its hash changes; its ids go to every reference."""

    def run(batches):
        enc, values = encoder(folder, name)
        width = id_type(len(values))
        last, ids = None, b""
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for h, chunk, refs in zip(*(c.to_pylist() for c in batch.columns)):
                if h != last:
                    last = h
                    ids = np.array(enc.encode_ordinary(chunk.decode("utf-8", "surrogatepass")), width).tobytes()
                for r in refs:
                    for column, value in zip(out, (r["doc"], r["row"], r["seq"], r["parts"], ids)):
                        column.append(value)
                    size += len(ids)
                    if size > 8 << 20:  # a chunk with many references doesn't pile up
                        yield _joined(out)
                        out, size = ([], [], [], [], []), 0
            yield _joined(out)

    return run


def _joined(out) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(out, kinds)], ["doc", "row", "seq", "parts", "ids"]
    )


def _safe(ids: np.ndarray, k: int, values: list[bytes]) -> bool:
    """Whether no piece of the pattern can hold what comes before and after the start of id k together:
    a space or line feed after a character that isn't white space."""
    after = values[ids[k]]
    if after[0] not in b" \n":
        return False
    tail = values[ids[k - 1]][-1]
    if tail < 0x80:
        return 0x21 <= tail <= 0x7E
    before = b"".join(values[i] for i in ids[max(0, k - 4) : k].tolist())[-4:].decode("utf-8", "ignore")
    return bool(before) and not before[-1].isspace()


def joined_ids(parts: list[np.ndarray], enc, values: list[bytes]) -> np.ndarray:
    """Ids of a text from those of its chunks, joins repaired."""
    if len(parts) == 1:
        return parts[0]
    done: list[np.ndarray] = []
    pending: list[np.ndarray] = []  # ids whose text is to be encoded again

    def settle() -> None:
        if pending:
            text = b"".join(values[i] for p in pending for i in p.tolist()).decode("utf-8", "surrogatepass")
            done.append(np.array(encode(enc, text), np.int64))
            pending.clear()

    for n, ids in enumerate(parts):
        low, high = 0, len(ids)
        if n:  # the first safe place
            low = next((k for k in range(1, len(ids)) if _safe(ids, k, values)), -1)
            if low < 0:
                pending.append(ids)
                continue
            pending.append(ids[:low])
            settle()
        if n < len(parts) - 1:  # the last one
            high = next((k for k in range(len(ids) - 1, low, -1) if _safe(ids, k, values)), low)
            done.append(ids[low:high])
            pending.append(ids[high:])
        else:
            done.append(ids[low:])
    settle()
    return np.concatenate(done)


def _assemble(folder: str, name: str):
    def run(batches):
        enc, values = encoder(folder, name)
        width = id_type(len(values))
        docs: list[int] = []
        lists: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        size = 0

        def out():
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            flat = np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "ids"],
            )

        for batch in batches:
            for doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc", "parts", "ids"))):
                parts.append(np.frombuffer(ids, width))
                if len(parts) == n:
                    docs.append(doc)
                    lists.append(joined_ids(parts, enc, values))
                    size += len(lists[-1])
                    parts = []
                    if size > 1 << 20:
                        yield out()
                        docs, lists, size = [], [], 0
        yield out()

    return run


def corpus_ids(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    folder: str = TOKENIZERS,
    name: str = "byte_bpe_50k",
    least_hot: int = 50,
) -> DataFrame:
    """doc_id, ids of every row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spread(df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text")))
    pieces = rows.mapInArrow(
        _pieces(least_hot),
        "h binary, salt int, chunk binary, refs array<struct<doc: long, row: long, seq: int, parts: int>>",
    )
    encoded = (
        pieces.repartition(n, "h", "salt")
        .sortWithinPartitions("h")
        .select("h", "chunk", "refs")
        .mapInArrow(_encode(folder, name), "doc long, row long, seq int, parts int, ids binary")
    )
    return (
        encoded.repartition(n, "row")
        .sortWithinPartitions("row", "seq")
        .mapInArrow(_assemble(folder, name), "doc_id long, ids array<int>")
    )

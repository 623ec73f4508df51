"""Token ids in raw files, with keyed access by a minimal perfect hash.

``write`` lays documents out in ascending order of their ids over shard files. A
shard is the concatenation of its documents' ids, little-endian integers of 2
bytes where the vocabulary fits and else of 4, each document ending in the end
id. One task writes one shard, under a name of its own first, so that a task run
again replaces the whole file.

The index maps a key, a ``doc_id`` and the number of its copy, to where the
document lies. Keys are dealt into buckets by hash, of about ``BUCKET`` keys at
any table size, and each bucket has a minimal perfect hash: levels of bits in
which each key that falls alone on a bit is settled there, and the rank of that
bit is the key's slot. A slot holds a fingerprint of its key, by which keys that
were never written are told apart, and shard, offset, length and start. A lookup
so reads one bucket's row and a few bits, whatever the table's size.

The summary of each shard (a row a shard) is the only thing that passes through
the driver.

Cases: a null text counts as empty, an empty text is the end id alone; texts of
any length are written whole; rows with equal ids are copies 0, 1, ... in the
order of their texts' hashes; rows with a null id come first, as copies of the
null key; an empty table gives no shards and an empty index; other columns are
not read.
"""

from __future__ import annotations

import functools
import json
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rewardloom.llm.common import WordCodes, offsets, saved

#: Keys of a bucket of the index, on average.
BUCKET = 4096
#: Bytes of text encoded at once, and pieces in one call of the tokenizer.
BYTES, WORDS = 16 << 20, 1024
#: Pieces whose ids a worker keeps.
MEMO = 400_000
#: Bytes of ids read before they are passed on.
BUFFER = 8 << 20

#: White space of more than one byte, its bytes as one number, by its size.
_WIDE = {n: [int.from_bytes(b) for k in range(0x80, 0x3001) if chr(k).isspace() and len(b := chr(k).encode("utf-8")) == n] for n in (2, 3)}
#: Kinds of bytes: white space, the first of wider white space, and ASCII letters, digits and marks.
_WHITE, _WIDE_LEAD, _LETTER, _DIGIT, _MARK = range(1, 6)
_KIND = np.zeros(256, np.uint8)
_KIND[[k for k in range(128) if chr(k).isspace()]] = _WHITE
_KIND[[b >> 8 * (n - 1) for n, wide in _WIDE.items() for b in wide]] = _WIDE_LEAD
for _kind, _chars in (_LETTER, string.ascii_letters), (_DIGIT, string.digits), (_MARK, string.punctuation):
    _KIND[list(_chars.encode())] = _kind
_PLACED = "shard int, place long, doc_id long, copy long, offset long, n_tokens long"
_SLOTS = "bucket long, n_keys int, levels array<binary>, fingerprint binary, shard binary, offset binary, n_tokens binary, start binary"
_FOUND = "doc_id long, copy long, shard int, offset long, n_tokens long, start long"


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class Encoder:
    """Ids of whole texts by a tokenizers file, as bytes.

    Many texts are cut at once, into pieces that begin and end where matches of the
    tokenizer's pattern do. Arrow finds the distinct pieces, only those are encoded
    or found in a bounded memo, and Arrow strings their ids together again.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        #: Strings that the tokenizer takes out of a text before all else; a text with one is encoded whole.
        self.added = [t["content"] for t in made["added_tokens"]]
        # Pieces may be encoded one by one if the tokenizer itself cuts there and changes no text.
        self.by_word = (
            split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not made["normalizer"]
            and not any(c.isspace() for t in self.added for c in t)  # so that none arises where pieces meet
        )
        #: Bytes of each token: such a tokenizer writes a byte as one character.
        self.length = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, rank in self.tokenizer.get_vocab().items():
            self.length[rank] = len(token)
        self.known = WordCodes(self._ids, MEMO)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Encodes pieces, many in one text; the tokens' lengths tell where each begins and ends.

        None ends in white space, nor begins with other than a lone space; where
        none stands between two, a lone line feed does, which is a match of its own.
        """
        text = "".join([p if p[0] == " " else "\n" + p for p in pieces])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        size = np.array([len(p) if p.isascii() else len(p.encode("utf-8")) for p in pieces])
        stop = np.cumsum(size + [p[0] != " " for p in pieces])
        ends = np.cumsum(self.length[ids])
        first, last = ((np.searchsorted(ends, x, "right") * ids.itemsize).tolist() for x in (stop - size, stop))
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip(first, last)]

    def _codes(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of distinct pieces."""
        codes = self.known.held(pieces)
        new, alone = [], []
        for k, code in enumerate(codes):
            if code is None:
                p = pieces[k]
                joins = len(p) <= 64 and not p[-1].isspace() and not (p[1] if p[0] == " " else p[0]).isspace()
                (new if joins and not any(a in p for a in self.added) else alone).append(k)
        for k in range(0, len(new), WORDS):
            at = new[k : k + WORDS]
            words = [pieces[i] for i in at]
            learned = self._learn(words)
            self.known.put_all(words, learned)
            for i, code in zip(at, learned):
                codes[i] = code
        for k in alone:
            codes[k] = self.known[pieces[k]]
        return codes

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each whole text."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.array(x.ids, self.dtype).tobytes() for x in found]
        begin = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        if begin[-1] == begin[0]:
            return [b""] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[begin[0] : begin[-1]]
        begin = begin - begin[0]
        cuts = sure_cuts(data)
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if whole.any():
            cuts = cuts[~whole[np.searchsorted(begin, cuts, "right") - 1]]
        starts = np.zeros(len(data) + 1, bool)
        starts[begin] = starts[cuts] = True
        bounds = np.flatnonzero(starts)
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        ids = pa.array(self._codes(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.searchsorted(bounds, begin)].tolist()
        body = memoryview(ids.buffers()[2] or b"")
        return [bytes(body[a:b]) for a, b in zip(ends, ends[1:])]


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """Places in the bytes of UTF-8 texts laid end to end where a match of the tokenizer's pattern starts, whatever else they hold.

    Such are a space between two characters that are not white space; a line feed
    between two such, and the character after it; and an ASCII letter, digit or
    mark after one of another of these kinds, but no letter after an apostrophe,
    which may be one match with it. Places left out only make pieces longer.
    """
    kind = _KIND[data]
    white = kind == _WHITE
    leads = np.flatnonzero(kind == _WIDE_LEAD)
    number = data[leads].astype(np.uint32)
    for size, wide in _WIDE.items():
        number = number << np.uint32(8) | data.take(leads + size - 1, mode="clip")
        at = leads[np.isin(number, wide)]
        white[at] = white[at + size - 1] = True
    starts = np.zeros(len(data), bool)
    left, right = kind[:-1], kind[1:]
    starts[1:] = (left != right) & (left >= _LETTER) & (right >= _LETTER) & ((data[:-1] != 0x27) | (right != _LETTER))
    lone = white[1:-1] & ~(white[:-2] | white[2:])
    feeds = np.flatnonzero(lone & (data[1:-1] == 0x0A)) + 1
    starts[1:-1] |= lone & (data[1:-1] == 0x20)
    starts[feeds] = starts[feeds + 1] = True
    return np.flatnonzero(starts)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``BYTES`` bytes of text each."""
    at = offsets(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))[:-1] // BYTES
    first = np.unique(at, return_index=True)[1].tolist()
    return zip(first, [*first[1:], len(texts)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.ids"


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each key among ``size`` bits of a level."""
    x = h1 + h2 * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def perfect_levels(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Bits of each level of a minimal perfect hash of distinct keys (h1, h2)."""
    levels = []
    while len(h1):
        if len(levels) > 200:
            raise ValueError("two keys have the same 128-bit hash")
        size = -(-2 * len(h1) // 64) * 64
        at = _mixed(h1, h2, len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        levels.append(bits)
        left = ~bits[at]
        h1, h2 = h1[left], h2[left]
    return levels


def slots(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Each key's slot, or -1. A key outside the set may get any."""
    out = np.full(len(h1), -1, np.int64)
    below = 0
    for level, bits in enumerate(levels):
        at = _mixed(h1, h2, level, len(bits))
        new = (out < 0) & bits[at]
        out[new] = below + (np.cumsum(bits) - 1)[at[new]]
        below += int(bits.sum())
    return out


def _key_hashes(doc_id: Column, copy: Column) -> list[Column]:
    return [F.xxhash64(doc_id, copy).alias("h1"), F.xxhash64(F.lit(1), copy, doc_id).alias("h2")]


@dataclass(frozen=True)
class TokenFiles:
    """Written shards with their index."""

    folder: str
    dtype: str
    n_buckets: int
    #: (doc_id, copy) of every document written.
    keys: DataFrame
    index: DataFrame

    def locate(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy, shard, offset, n_tokens, start) of the keys that were written.

        :param keys: distinct keys, with columns doc_id and copy.
        """

        def find(asked: pa.Table, bucket: pa.Table) -> pa.Table:
            names = ["doc_id", "copy", "shard", "offset", "n_tokens", "start"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            if not (asked.num_rows and bucket.num_rows):
                return pa.table([pa.array([], t) for t in types], names)
            row = bucket.to_pylist()[0]
            levels = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in row["levels"]]
            h1, h2 = (asked.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            at = slots(levels, h1, h2)
            known = np.frombuffer(row["fingerprint"], "<u4")
            hit = at >= 0
            hit[hit] = known[at[hit]] == (h2[hit] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            values = [np.frombuffer(row[c], "<i4" if c == "shard" else "<i8")[at[hit]] for c in names[2:]]
            kept = asked.filter(pa.array(hit))
            return pa.table([kept.column("doc_id").combine_chunks(), kept.column("copy").combine_chunks(), *map(pa.array, values)], names)

        asked = keys.select("doc_id", "copy", *_key_hashes(F.col("doc_id"), F.col("copy")))
        asked = asked.withColumn("bucket", F.pmod("h1", F.lit(self.n_buckets)))
        return asked.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInArrow(find, _FOUND)

    def payloads(self, keys: DataFrame, wide: bool = False) -> DataFrame:
        """(doc_id, copy, start, n_tokens, ids): the ids of the given keys, as stored.

        :param wide: give every id 4 bytes.
        """
        folder, dtype, width = self.folder, self.dtype, np.dtype(self.dtype).itemsize

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = store(folder)
            opened, file = None, None
            try:
                for batch in batches:
                    shard, offset, n = (batch.column(c).to_pylist() for c in ("shard", "offset", "n_tokens"))
                    done, held = 0, []
                    size = 0
                    for k in range(batch.num_rows):
                        if shard[k] != opened:
                            if file is not None:
                                file.close()
                            opened, file = shard[k], system.open_input_file(f"{root}/{_shard_name(shard[k])}")
                        stored = file.read_at(n[k] * width, offset[k] * width)
                        held.append(np.frombuffer(stored, dtype).astype("<u4").tobytes() if wide else stored)
                        size += len(held[-1])
                        if size >= BUFFER or k + 1 == batch.num_rows:
                            rows = batch.slice(done, k + 1 - done)
                            yield pa.RecordBatch.from_arrays(
                                [*(rows.column(c) for c in ("doc_id", "copy", "start", "n_tokens")), pa.array(held, pa.binary())],
                                ["doc_id", "copy", "start", "n_tokens", "ids"],
                            )
                            done, held, size = k + 1, [], 0
            finally:
                if file is not None:
                    file.close()

        found = self.locate(keys).repartition("shard").sortWithinPartitions("shard", "offset")
        return found.mapInArrow(read, "doc_id long, copy long, start long, n_tokens long, ids binary")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> TokenFiles:
    """Writes every document's ids below ``folder`` and indexes them.

    :param folder: on a file system that all machines see.
    :param tokenizer: a tokenizers file, on every machine.
    """
    spark = docs.sparkSession
    system, root = store(folder)
    system.create_dir(root, recursive=True)
    dtype = encoder(tokenizer).dtype
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text).cast("string")).alias("tie"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "tie", "row"]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        end = np.array([end_id], codes.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        files, top = store(folder)
        own = f"{top}/{_shard_name(shard)}.{uuid.uuid4().hex}"
        place, offset, copy, last, begun = 0, 0, 0, None, False
        out = None
        for batch in batches:
            n, copies = [], []
            out = out or files.open_output_stream(own)
            for k, stop in _parts(batch.column("text")):
                part = batch.slice(k, stop - k)
                coded = codes.encode(part.column("text"))
                out.write(end.join(coded) + end)
                n += [len(x) // len(end) + 1 for x in coded]
                for key in part.column("doc_id").to_pylist():
                    copy = copy + 1 if begun and key == last else 0
                    last, begun = key, True
                    copies.append(copy)
            at = offsets(np.array(n, np.int64)) + offset
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), shard, np.int32)), pa.array(np.arange(place, place + len(n))), batch.column("doc_id"),
                    pa.array(copies, pa.int64()), pa.array(at[:-1]), pa.array(n, pa.int64()),
                ],
                ["shard", "place", "doc_id", "copy", "offset", "n_tokens"],
            )
            place, offset = place + len(n), int(at[-1])
        if out is not None:
            out.close()
            files.move(own, f"{top}/{_shard_name(shard)}")

    placed = saved(rows.select("doc_id", "text").mapInArrow(put, _PLACED), "placed")
    shards = (
        placed.groupBy("shard")
        .agg(
            F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"),
            F.min_by("doc_id", "place").alias("first_id"), F.max_by(F.struct("doc_id", "copy"), "place").alias("last"),
        )
        .orderBy("shard").collect()
    )
    # Where each shard begins in the whole, and how many copies of its first id lie before it.
    base, carry, summary, before = 0, 0, [], None
    for s in shards:
        carry = before["last"]["copy"] + 1 + (carry if before["first_id"] == before["last"]["doc_id"] else 0) if before and before["last"]["doc_id"] == s["first_id"] else 0
        summary.append((s["shard"], base, s["first_id"], carry))
        base, before = base + s["tokens"], s
    n_buckets = max(1, -(-sum(s["rows"] for s in shards) // BUCKET))
    summary = spark.createDataFrame(summary, "shard int, base long, first_id long, carry long")
    # One row a shard.
    keyed = placed.join(F.broadcast(summary), "shard").select(
        "doc_id", (F.col("copy") + F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("carry")).otherwise(0)).alias("copy"),
        "shard", "offset", "n_tokens", (F.col("base") + F.col("offset")).alias("start"),
    )

    def build(bucket: pa.Table) -> pa.Table:
        h1, h2 = (bucket.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        levels = perfect_levels(h1, h2)
        order = np.argsort(slots(levels, h1, h2))
        columns = {c: bucket.column(c).to_numpy()[order].astype("<i4" if c == "shard" else "<i8").tobytes() for c in ("shard", "offset", "n_tokens", "start")}
        row = {
            "bucket": bucket.column("bucket")[0].as_py(), "n_keys": len(h1), "levels": [np.packbits(x).tobytes() for x in levels],
            "fingerprint": (h2[order] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), **columns,
        }
        return pa.Table.from_pylist([row], schema=pa.schema([
            ("bucket", pa.int64()), ("n_keys", pa.int32()), ("levels", pa.list_(pa.binary())), ("fingerprint", pa.binary()),
            ("shard", pa.binary()), ("offset", pa.binary()), ("n_tokens", pa.binary()), ("start", pa.binary()),
        ]))

    hashed = keyed.select(*_key_hashes(F.col("doc_id"), F.col("copy")), "shard", "offset", "n_tokens", "start")
    hashed = hashed.withColumn("bucket", F.pmod("h1", F.lit(n_buckets)))
    index_path = f"{folder}/index"
    hashed.groupBy("bucket").applyInArrow(build, _SLOTS).write.parquet(index_path)
    index = spark.read.schema(_SLOTS).parquet(index_path)
    return TokenFiles(folder, dtype, n_buckets, keyed.select("doc_id", "copy"), index)

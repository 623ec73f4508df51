"""Byte-level BPE encoding and decoding from a file of ranks.

Bytes stand as Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds the longest token at every place of a piece in one pass. The
encoder takes the longest token that may follow the one before it, and steps
back to the next shorter token, or past the token before, where none may. Two
tokens may be neighbours if merging their bytes alone leaves the border between
them; the answer is kept for each pair. A dead place is never tried twice, so
the work is linear in the piece. The ids equal those of merging the lowest rank
first.

A text is cut at the pattern's matches, and each match is encoded on its own, or
taken whole if it is a token. A space between two characters that are not white
space always starts a match, so text is cut there first and the codes of such
words are kept in a bounded memo.

Cases: a null text counts as empty, an empty text has no ids; texts of any length
are encoded whole; repeated rows are encoded each for itself; other columns are
not read. Null ids decode to no bytes; an unknown id raises.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.common import WordCodes

#: Texts that a worker holds with their ids at once.
ROWS = 256

_ODD_SPACE = re.compile(r" \s|\s ")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def words_of(text: str) -> list[str]:
    """Cuts text at spaces where a match of the pattern must start.

    Each word but the first goes with the space before it, which is left out.
    """
    return _LONE_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairs:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        trie = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge_below(token, rank)
                if len(parts) != 2:
                    continue  # no merges lead to it: only a whole match can be this token
                self.halves[rank] = parts[0], parts[1]
                self.merged[parts[0], parts[1]] = rank
            trie.add_word(token.decode("latin-1"), rank)
        trie.make_automaton()
        self.trie = trie
        self.length = [0] * (max(ranks.values()) + 1)
        #: The longest shorter token that begins like this one, or -1.
        self.shorter = [-1] * len(self.length)
        for text, rank in trie.items():
            self.length[rank] = len(text)
            self.shorter[rank] = next((trie.get(text[:n]) for n in range(len(text) - 1, 0, -1) if trie.exists(text[:n])), -1)
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.after_space = WordCodes(lambda word: self._code(" " + word))
        self.at_start = WordCodes(self._code)
        self.piece_code = WordCodes(lambda piece: np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes())

    def _merge_below(self, token: bytes, limit: int) -> list[int]:
        """Ids of ``token`` after all merges of a rank below ``limit``."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], limit), k) for k in range(len(parts) - 1))
            if rank >= limit:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens leaves the border between them."""
        if len(self.neighbours) >= 1 << 20:
            self.neighbours.clear()
        holds = self.neighbours[left, right] = self._border_holds(left, right)
        return holds

    def _border_holds(self, a: int, b: int) -> bool:
        # Undo the latest merge of either side step by step. The border is lost if, at some
        # step, the parts beside it would merge before the merge that was just undone.
        undone = None
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and (undone is None or joint < undone[0] or (joint == undone[0] and undone[1])):
                return False
            left, right = self.halves.get(a), self.halves.get(b)
            if left is None and right is None:
                return True
            # Of two equal ranks the left one merges first, so it was undone last.
            if right is None or (left is not None and a > b):
                undone, a = (a, False), left[1]
            else:
                undone, b = (b, True), right[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, length, shorter, known = len(piece), self.length, self.shorter, self.neighbours
        longest = [-1] * size
        for end, rank in self.trie.iter(piece.decode("latin-1")):
            longest[end - length[rank] + 1] = rank
        alive = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < size:
            while token >= 0:
                if alive[at + length[token]]:
                    fits = last < 0 or known.get((last, token))
                    if fits is None:
                        fits = self.may_follow(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token < 0:
                alive[at] = 0
                token = out.pop()  # tried again, it ends at a dead place and so gives way to a shorter one
                at -= length[token]
                last = out[-1] if out else -1
            else:
                out.append(token)
                at += length[token]
                last, token = token, longest[at] if at < size else -1
        return out

    def _code(self, word: str) -> bytes:
        return self.piece_code.of(self.find(word))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        words = words_of(text or "")
        return self.at_start[words[0]] + self.after_space.of(words[1:])

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """The vocabulary, read once in a worker."""
    return BytePairs(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids): every whole text's ids as little-endian unsigned 32-bit integers.

    :param path: file of ranks, on every machine.
    :param decoded: also decode the ids, as column ``decoded``, in the same worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                ids = [pairs.encode(t.as_py()) for t in part.column("text")]
                columns, names = [part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"]
                if decoded:
                    columns.append(pa.array([pairs.decode(x) for x in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary" + ", decoded binary" * decoded)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that a column of encoded ids stands for."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        pairs = byte_pairs(path, pattern)
        return pd.Series([pairs.decode(x) for x in column], dtype=object)

    return run(ids)

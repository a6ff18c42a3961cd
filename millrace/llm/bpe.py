"""Byte-level BPE encoding of a corpus with a public vocabulary, and its inverse.

A text is cut into pieces by the vocabulary's pattern; each piece is encoded by a priority queue of merge ranks over a
doubly linked list of symbols. Entries of the queue whose symbols have merged meanwhile are stale and skipped. Pieces
repeat heavily, so each Python worker keeps those it has encoded, up to ``KEPT_PIECES``.

Null and empty texts have the empty list of ids. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; MILLRACE_TOKENIZERS or the parameter ``vocab`` names another.
VOCAB_DIR = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"
#: Pieces a worker remembers before it starts anew; about 150 MB at most.
KEPT_PIECES = 500_000
#: Longer pieces are encoded but not remembered.
LONGEST_KEPT = 64
#: Fixed value: the published pre-tokenisation pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocab_path(name: str = DEFAULT) -> str:
    return name if "/" in name else f"{VOCAB_DIR}/{name}.tiktoken"


class BytePairEncoder:
    """Encoder and decoder of one vocabulary of byte strings and ranks; a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.of_byte = [self.rank[bytes([b])] for b in range(256)]
        # (left id, right id) -> id of the merged token, for every split of every token into two tokens
        self.merge = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    self.merge[left, right] = rank
        import regex

        self.pieces = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: always the pair of least rank merges next, of equal ranks the leftmost."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        symbol = [self.of_byte[b] for b in piece]
        n, merge = len(symbol), self.merge
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(merge[pair], i, *pair) for i in range(n - 1) if (pair := (symbol[i], symbol[i + 1])) in merge]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue  # stale: one of the two has merged since
            symbol[i], symbol[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := (rank, symbol[k])) in merge:
                    heapq.heappush(queue, (merge[pair], i, *pair))
            h = before[i]
            if h >= 0 and (pair := (symbol[h], rank)) in merge:
                heapq.heappush(queue, (merge[pair], h, *pair))
        return [s for s in symbol if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        kept = self.kept
        for piece in self.pieces(text) if text else ():
            ids = kept.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= LONGEST_KEPT:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join([self.token[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(4)
def encoder(path: str) -> BytePairEncoder:
    """The encoder of ``path``, built once per Python worker."""
    return BytePairEncoder(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT, ids_col: str = "ids") -> DataFrame:
    """(id, ids): the token ids of every row's text, one row in, one row out; an empty table gives an empty table.

    A map over Arrow batches without a shuffle. Other columns of ``df`` are not read.
    """
    path = vocab_path(vocab)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            lists = [np.asarray(bpe.encode(t), np.int32) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], [id_col, ids_col])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT, out_col: str = "n_tokens") -> DataFrame:
    """(id, n_tokens) of every row; 0 for null and empty texts. The ids themselves never leave the worker."""
    path = vocab_path(vocab)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            counts = pa.array([len(bpe.encode(t)) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], [id_col, out_col])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` int")


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "text", vocab: str = DEFAULT) -> DataFrame:
    """``df`` with ``ids_col`` replaced by the text it stands for; null ids give null."""
    path = vocab_path(vocab)

    @F.pandas_udf("string")
    def text_of(column):
        bpe = encoder(path)
        return column.map(lambda ids: None if ids is None else bpe.decode(ids))

    return df.withColumn(text_col, text_of(ids_col)).drop(*({ids_col} - {text_col}))

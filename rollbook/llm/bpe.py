"""BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rollbook.llm import workers
from rollbook.llm.wordcode import WORD_END, PieceCoder, Vocabulary, read_vocabulary

_NONE = 1 << 62
_PLACE = (1 << 32) - 1


class PairTree:
    """BPE merges of one word.

    Leaf i holds rank and place of the pair of symbol i and its right
    neighbour; an inner node holds the least of its children, so the root is
    the leftmost pair of lowest rank. A merge changes three leaves at most,
    each in logarithmic time.
    """

    def __init__(self, symbols: list[int], pairs: dict[int, tuple[int, int]]):
        self.symbols, self.pairs = symbols, pairs
        n = len(symbols)
        self.right = list(range(1, n + 1))
        self.left = list(range(-1, n - 1))
        self.size = 1 << max(0, (n - 2).bit_length())
        self.tree = [_NONE] * (2 * self.size)
        for i in range(n - 1):
            self.tree[self.size + i] = self._rank(i)
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def _rank(self, i: int) -> int:
        j = self.right[i]
        if j >= len(self.symbols):
            return _NONE
        found = self.pairs.get(self.symbols[i] << 32 | self.symbols[j])
        return _NONE if found is None else found[0] << 32 | i

    def _set(self, i: int, value: int) -> None:
        tree = self.tree
        i += self.size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    def merged(self) -> list[int]:
        symbols, left, right, n = self.symbols, self.left, self.right, len(self.symbols)
        while self.tree[1] < _NONE:
            i = self.tree[1] & _PLACE
            j = right[i]
            symbols[i] = self.pairs[symbols[i] << 32 | symbols[j]][1]
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            symbols[j] = -1
            if j < n - 1:
                self._set(j, _NONE)
            self._set(i, self._rank(i))
            if left[i] >= 0:
                self._set(left[i], self._rank(left[i]))
        return [s for s in symbols if s >= 0]


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary_text: str):
        self.vocabulary = v = Vocabulary(vocabulary_text)
        self.pairs = {}
        for rank, (a, b) in enumerate(v.merges):
            self.pairs.setdefault(v.ids[a] << 32 | v.ids[b], (rank, v.ids[a + b]))
        self.coder = PieceCoder(v, self.code_word)
        self.numerals = [str(i) for i in range(len(v.strings))]

    def code_word(self, word: str) -> list[int]:
        ids = self.vocabulary.ids
        spelt = [ids[c] for c in word[:-1]] + [ids[word[-1] + WORD_END]]
        return spelt if len(spelt) == 1 else PairTree(spelt, self.pairs).merged()

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.coder.encode(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer file without a decoder has it."""
        strings = self.vocabulary.strings
        return " ".join([strings[i] for i in ids])


def loaded(text: str) -> Bpe:
    """One coder in a worker, kept from task to task with what it remembers."""
    return workers.kept(("bpe", hash(text)), lambda: Bpe(text))


def encode_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text, in its own task and without a shuffle.

    Rows: the id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by a space)
    and ``decoded_sha256``; with ``with_ids`` also ``ids`` and ``decoded``.
    Null and empty texts have no tokens and decode to the empty text; rows
    with equal ids, null ids and extra columns pass (extra ones are left out).
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    source = docs.select(id_col, text_col)
    fields = [source.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        numerals = bpe.numerals
        for whole in batches:
            # a few texts at a time: their ids take several times the room of the texts
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                counts, digests, back, ids = [], [], [], []
                for text in batch.column(1).to_pylist():
                    own = bpe.coder.encode(text)
                    listed = array("I", own).tolist()
                    decoded = bpe.decode(listed)
                    counts.append(len(listed))
                    digests.append((hashlib.sha256(" ".join([numerals[i] for i in listed]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    if with_ids:
                        ids.append(own)
                        back.append(decoded)
                columns = [batch.column(0), pa.array(counts, pa.int64()), *[pa.array(x, pa.string()) for x in zip(*digests, strict=True)]]
                if with_ids:
                    ends = pa.array(np.cumsum([0, *counts]).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32))), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))

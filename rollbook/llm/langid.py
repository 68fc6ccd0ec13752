"""Language ID by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ``order`` long is counted on
learning texts and then frozen. A byte's probability comes from the longest
context in the tree: n/(N+q) for a byte seen there n times among N with q
distinct bytes, and otherwise the escape q/(N+q) times the shorter context's
probability among the bytes not seen (exclusion); below the empty context all
bytes are equal. Probabilities of a context sum to one, so -log2 is the exact
code length of an ideal coder. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm import workers

ORDER = 3
UNIT = 1 / 512  # code lengths are held in these parts of a bit
BLOCK = 500  # contexts whose probabilities are worked out at once
LETTER = regex.compile(r"\p{L}")


def learning_rows(docs: DataFrame, *, id_col: str, text_col: str, label_col: str, bound: int) -> DataFrame:
    """Labelled rows to learn from, about ``bound`` a language at most, chosen by a hash of the id over the whole table."""
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(label_col).alias("_label"))
    sizes = docs.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("_label")).agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    return rows.join(F.broadcast(sizes), "_label").where(draw * F.col("_n") < bound).drop("_n")


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """How often each byte follows each context of ``order`` bytes, for each label; counted in the tasks, then summed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, texts in pdf.groupby("_label")["_text"]:
                data = b"".join(b" " * order + t.encode("utf-8", "replace") for t in texts)
                code = _codes(np.frombuffer(data, np.uint8), order + 1)
                grams, n = np.unique(code, return_counts=True)
                yield pd.DataFrame({"label": label, "gram": grams.astype(np.int64), "n": n})

    return rows.select("_label", "_text").mapInPandas(run, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def _codes(data: np.ndarray, width: int) -> np.ndarray:
    """The number that the last ``width`` bytes make, at each place that has so many."""
    wide = data.astype(np.uint32)
    code = np.zeros(max(0, len(data) - width + 1), np.uint32)
    for i in range(width):
        code = code << np.uint32(8) | wide[i : len(data) - width + 1 + i]
    return code


class Model:
    """Frozen tables: the node of each context and, for each node, byte and language, the code length."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER, least: int = 8):
        self.order = order
        self.labels = sorted(counts["label"].unique())
        grams = counts["gram"].to_numpy(np.int64)
        used = np.unique(np.concatenate([(grams >> 8 * i) & 255 for i in range(order + 1)])) if len(grams) else np.zeros(0, np.int64)
        # bytes never learnt share the last symbol
        self.symbol = np.full(256, len(used), np.int64)
        self.symbol[used] = np.arange(len(used))
        self.width = a = len(used) + 1
        if not self.labels:
            return
        self.blank = int(self.symbol[32])
        label = np.searchsorted(self.labels, counts["label"].to_numpy(str))
        number = counts["n"].to_numpy(float)
        size, kinds = 1, len(self.labels)
        levels = []  # for each context length: its contexts, and where each count of (context, language, byte) goes
        for k in range(order + 1):
            contexts, cells, n = self._level(grams, label, number, k, least)
            levels.append((contexts, cells, n))
            size += len(contexts)
        self.node = np.zeros(a**order, np.int32)
        self.table = np.zeros((size - 1) * a * kinds, np.uint16).reshape(-1, a, kinds)
        shorter, below, done = np.zeros(0, np.int64), np.full((1, kinds, a), 1 / a), 0
        for k, (contexts, cells, n) in enumerate(levels):
            held = []
            for at in range(0, len(contexts), BLOCK):
                some = contexts[at : at + BLOCK]
                first, last = np.searchsorted(cells, [at * kinds * a, (at + len(some)) * kinds * a])
                full = np.zeros(len(some) * kinds * a)
                full[cells[first:last] - at * kinds * a] = n[first:last]
                # the shorter context drops the oldest byte; it was counted at least as often, so it is in the tree
                above = below[np.searchsorted(shorter, some % a ** (k - 1))] if k else below
                p = self._mixed(full.reshape(-1, kinds, a), above)
                self.table[done : done + len(some)] = np.minimum(np.round(-np.log2(p) / UNIT), 65535).transpose(0, 2, 1)
                nodes = np.arange(done, done + len(some), dtype=np.int32)
                self.node.reshape(a ** (order - k), a**k)[:, some] = nodes
                done += len(some)
                if k < order:
                    held.append(p)
            shorter, below = contexts, np.concatenate(held) if held else np.zeros((0, kinds, a))
        self.table = self.table.reshape(-1, kinds)

    def _level(self, grams: np.ndarray, label: np.ndarray, number: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of ``k`` bytes counted ``least`` times or more, in order, and the counts of their bytes: places in (context, language, byte), ascending, and numbers."""
        a, kinds = self.width, len(self.labels)
        context = np.zeros(len(grams), np.int64)
        for i in range(k, 0, -1):
            context = context * a + self.symbol[(grams >> 8 * i) & 255]
        contexts, where = np.unique(context, return_inverse=True)
        kept = (np.bincount(where, number) >= least) | (k == 0)
        cell = (((np.cumsum(kept) - 1)[where] * kinds + label) * a + self.symbol[grams & 255])[kept[where]]
        cells, place = np.unique(cell, return_inverse=True)
        return contexts[kept], cells, np.bincount(place, number[kept[where]], len(cells))

    @staticmethod
    def _mixed(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities of contexts (context, language, byte) from their counts and the shorter contexts' probabilities."""
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        left = np.where(n > 0, 0, shorter)
        rest = left.sum(-1, keepdims=True)
        whole = total + np.where(rest > 0, kinds, 0)
        known = np.where(total > 0, n / np.maximum(whole, 1), 0)
        escape = np.where(total > 0, kinds / np.maximum(whole, 1), 1)
        return known + np.where(rest > 0, escape * left / np.where(rest > 0, rest, 1), 0)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language, in bits."""
        out = np.zeros((len(texts), len(self.labels)), np.int64)
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (size == 0 or size + len(texts[upto]) < 1 << 18):
                size += len(texts[upto]) + self.order
                upto += 1
            self._block(texts[at:upto], out[at:upto])
            at = upto
        return out * UNIT

    def _block(self, texts: list[bytes], out: np.ndarray) -> None:
        k, a = self.order, self.width
        gap = b" " * k
        symbols = self.symbol[np.frombuffer(gap + gap.join(texts), np.uint8)]
        context = np.zeros(len(symbols) - k, np.int64)
        for i in range(k):
            context = context * a + symbols[i : len(symbols) - k + i]
        cell = self.node[context].astype(np.int64) * a + symbols[k:]
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + k) - sizes - k
        lengths = self.table[cell]
        for j in range(len(self.labels)):
            sums = np.concatenate([[0], np.cumsum(lengths[:, j], dtype=np.int64)])
            out[:, j] = sums[starts + sizes] - sums[starts]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", bound: int = 1500, order: int = ORDER, least: int = 8) -> Model:
    """Fit on about ``bound`` documents a language (a documented bound on a hash-chosen sample); their counts alone reach the driver."""
    rows = learning_rows(docs, id_col=id_col, text_col=text_col, label_col=label_col, bound=bound)
    return Model(gram_counts(rows, order).toPandas(), order, least)


def language(text_col: str, model: Model, spark: SparkSession) -> Column:
    """A struct of ``lang_pred`` and ``score`` for each whole text, computed in the text's own task.

    The score is the winner's share of 2^(-bits/T) over the languages, T the
    root of the text's bytes: 1/languages for no evidence, near 1 for much. A
    text that is null or has no letter is ``und`` with score 0, and so is any
    text where nothing was learnt. Of equal codes the first label wins.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        workers.free()
        for texts in parts:
            n = len(texts)
            label, score = np.full(n, "und", object), np.zeros(n)
            good = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
            for at in range(0, len(good) if model.labels else 0, 500):
                some = good[at : at + 500]
                data = [texts.iat[i].encode("utf-8", "replace") for i in some]
                bits = model.lengths(data)
                best = bits.argmin(1)
                heat = np.sqrt([len(d) for d in data])
                label[some] = np.array(model.labels, object)[best]
                score[some] = 1 / np.exp2(np.maximum(-1000, (bits[np.arange(len(some)), best][:, None] - bits) / heat[:, None])).sum(1)
            yield pd.DataFrame({"lang_pred": label, "score": score})

    return F.pandas_udf(run, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))(F.col(text_col))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``lang_pred`` and ``score`` of each row; rows with equal or null ids are all kept, extra columns left out."""
    judged = docs.select(id_col, language(text_col, model, docs.sparkSession).alias("_judged"))
    return judged.select(id_col, "_judged.lang_pred", "_judged.score")


def known_languages(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Rows whose language is known; those judged ``und`` go. All columns are kept as they are."""
    named = F.struct(language(text_col, model, docs.sparkSession).alias("j"))["j"]["lang_pred"]
    return docs.where(named != "und")

"""Benchmark decontamination: pigeonhole edit matching.

A test item that may differ from a passage in k edits is cut into k+1 pieces;
some piece then stands in the passage unchanged. All pieces are sought at once
in each document, and each place where one stands is verified with Myers'
bit-parallel edit distance. Texts are compared in lower case with white space
runs as one space; places are offsets in that form.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm import workers

EDITS = 0.08  # edits allowed for each character of an item
INDEX_CHARS = 4_000_000  # characters of items in one automaton, which takes some 54 bytes for each in every worker; more items take more passes

HITS = "array<struct<item:{},distance:int,start:int,end:int>>"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """Least edit distance of ``pattern`` to the parts of ``text`` that end at each place (from the text's start if anchored), after Myers 1999."""
    m = len(pattern)
    top, full = 1 << (m - 1), (1 << m) - 1
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    plus, minus, score, out = full, 0, m, []
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(diagonal | plus)
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | anchored) & full
        down = down << 1 & full
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical
        out.append(score)
    return out


class Finder:
    """Items, their pieces in one automaton, and the search of a text."""

    def __init__(self, items: list[str], edits: float = EDITS):
        self.items = items
        self.allowed = [int(len(x) * edits) for x in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for at, (item, k) in enumerate(zip(items, self.allowed, strict=True)):
            for p in range(k + 1):
                a, z = p * len(item) // (k + 1), (p + 1) * len(item) // (k + 1)
                pieces.setdefault(item[a:z], []).append((at, z))
        self.machine = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.machine.add_word(piece, places)
        if pieces:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item's best place in the text, the first of equals."""
        if not text or not self.items:
            return []
        text = normal(text)
        lines: dict[int, set[int]] = defaultdict(set)  # where the item would begin, by its pieces' hits
        for last, places in self.machine.iter(text):
            for at, z in places:
                lines[at].add(last + 1 - z)
        found = []
        for at, begins in lines.items():
            best = self._verify(at, sorted(begins), text)
            if best:
                found.append((at, *best))
        return sorted(found)

    def _verify(self, at: int, begins: list[int], text: str) -> tuple[int, int, int] | None:
        item, k = self.items[at], self.allowed[at]
        if not k:
            # an item too brief for an edit is sought as words of its own
            alone = (b for b in begins if not (text[b - 1 : b].isalnum() and item[0].isalnum()) and not (text[b + len(item) : b + len(item) + 1].isalnum() and item[-1].isalnum()))
            first = next(alone, None)
            return None if first is None else (0, first, first + len(item))
        best = None
        i = 0
        while i < len(begins):
            j = i
            while j + 1 < len(begins) and begins[j + 1] - begins[j] <= k:
                j += 1
            low = max(0, begins[i] - k)
            window = text[low : begins[j] + len(item) + k]
            scores = myers(item, window)
            least = min(scores, default=k + 1)
            if least <= k and (best is None or least < best[0]):
                end = scores.index(least) + 1
                back = myers(item[::-1], window[:end][::-1], True)
                best = (least, low + end - 1 - back.index(least), low + end)
            i = j + 1
        return best


def _hits(text: Column, sent: Broadcast, item_type: str) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, items, edits = sent.value
        finder = workers.kept(("decontamination", hash((tuple(items), edits))), lambda: Finder(items, edits))
        for texts in parts:
            yield pd.Series([[dict(zip(("item", "distance", "start", "end"), (ids[h[0]], *h[1:]), strict=True)) for h in finder.find(t)] for t in texts], dtype=object)

    return F.pandas_udf(run, HITS.format(item_type))(text)


def item_groups(items: DataFrame, *, item_col: str, text_col: str, index_chars: int = INDEX_CHARS) -> Iterator[list[tuple]]:
    """Items to seek, a bounded number of characters at a time."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // index_chars)
    for g in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == g)
        kept = [(r.id, normal(r.text)) for r in part.collect()]
        kept = sorted((x for x in kept if x[1]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if kept:
            yield kept


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Each item that stands in a whole text with at most ``edits`` of its length in edits.

    Rows: the document's id, the item's id, distance, start and end of the
    best place (the first of equals). Items too brief for an edit are found as
    words of their own. Null and empty texts have none; null and empty items
    are not sought; rows with equal or null ids each have their own; an item
    given twice is found twice. Ids and texts of a bounded number of
    characters of items at a time pass through the driver to the tasks.
    """
    spark, out = docs.sparkSession, None
    source = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    item_type = items.schema[item_col].dataType
    kind = item_type.simpleString()
    for group in item_groups(items, item_col=item_col, text_col=item_text, index_chars=index_chars):
        sent = spark.sparkContext.broadcast(([i for i, _ in group], [t for _, t in group], edits))
        hit = source.select("_doc", F.explode(_hits(F.col("_text"), sent, kind)).alias("h"))
        part = hit.select(F.col("_doc").alias(id_col), F.col("h.item").alias(item_col), "h.distance", "h.start", "h.end")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return source.where("false").select(F.col("_doc").alias(id_col), F.lit(None).cast(item_type).alias(item_col), *[F.lit(0).alias(c) for c in ("distance", "start", "end")])
    return out


def clean_documents(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = EDITS, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Rows in which no item stands; all columns are kept as they are."""
    for group in item_groups(items, item_col=item_col, text_col=item_text, index_chars=index_chars):
        sent = docs.sparkSession.sparkContext.broadcast(([0] * len(group), [t for _, t in group], edits))
        docs = docs.where(F.size(_hits(F.col(text_col), sent, "int")) == 0)
    return docs

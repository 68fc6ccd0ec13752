"""A dataset's manifest as trees of digests: one for each source, and one over their roots.

Every parent is stored with its preimage, the digests of its children one
behind the other. A leaf joins the preimages of its ancestors: its siblings are
a preimage without the leaf's own 64 characters, and a replaced leaf is folded
to the root by putting its digest in their place, level by level.

A tree is built in tiers of ``STEP`` levels: 3^STEP neighbouring nodes meet in
one row, which holds the preimages above them, so a tier takes one shuffle
however many levels it has, and no row grows with its source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.running import running
from rollbook.llm.scratch import cut

FAN, STEP = 3, 4
WIDTH = FAN**STEP
DIGEST = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<preimage: string, slot: int>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as UTF-8 byte count, colon and text; null as a hyphen. Numbers are decimal."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[field(c) for c in values])


@dataclass
class Tree:
    """``tiers``: tables of blocks (tree, up, kids, levels, preimages of each level, top), leaves first; ``tops``: tree and its root."""

    tiers: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame) -> Tree:
    """Trees over ``nodes``: ``tree`` (not null), ``at`` (0, 1, ... in order), ``n`` (nodes of the tree), ``node`` (digest); more columns stay with the leaves.

    While a tree has several nodes, every three neighbours (the last run may
    have fewer, even one) become the digest of their digests. A tree of one
    node is its own root.
    """
    tiers, most = [], None
    payload = [c for c in nodes.columns if c not in ("tree", "n")]
    while most is None or most > 1:
        grouped = nodes.groupBy("tree", F.expr(f"at DIV {WIDTH}").alias("up")).agg(F.array_sort(F.collect_list(F.struct(*payload))).alias("kids"), F.max("n").alias("n"))
        powers = F.array(*[F.lit(FAN**k).cast("long") for k in range(39)])
        tier = grouped.withColumns({"levels": F.least(F.lit(STEP), F.size(F.filter(powers, lambda p: p < F.col("n")))), "_nodes": F.transform("kids", lambda k: k["node"])})
        none = F.array().cast("array<string>")
        for k in range(1, STEP + 1):
            runs = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_nodes) - 1) DIV {FAN}")), lambda i: F.array_join(F.slice("_nodes", i * FAN + 1, FAN), ""))
            tier = tier.withColumn(f"pre{k}", F.when(F.col("levels") >= k, runs).otherwise(none))
            tier = tier.withColumn("_nodes", F.when(F.col("levels") >= k, F.transform(f"pre{k}", lambda x: F.sha2(x, 256))).otherwise(F.col("_nodes")))
        tier = cut(tier.withColumn("top", F.get("_nodes", F.lit(0))).drop("_nodes"))
        tiers.append(tier)
        nodes = tier.select("tree", F.col("up").alias("at"), F.col("top").alias("node"), F.expr(f"(n + {WIDTH - 1}) DIV {WIDTH}").alias("n"))
        payload = ["at", "node"]
        most = nodes.agg(F.max("n")).first()[0] or 0
    return Tree(tiers, nodes.select("tree", F.col("node").alias("top")))


def paths(built: Tree, above: DataFrame) -> DataFrame:
    """Each leaf's columns with ``path``, the preimages of its ancestors and its slot in each, nearest first, then what ``above`` (tree, path, more columns) has of its tree."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    reach = above.withColumn("up", F.lit(0).cast("long"))
    for i, tier in reversed(list(enumerate(built.tiers))):
        def own(at: Column) -> Column:
            steps = [F.struct(F.get(F.col(f"pre{k}"), (at / FAN**k).cast("int")).alias("preimage"), ((at / FAN ** (k - 1)).cast("int") % FAN).alias("slot")) for k in range(1, STEP + 1)]
            return F.slice(F.array(*steps), F.lit(1), F.col("levels"))

        over = reach.withColumnsRenamed({"tree": "_tree", "up": "_up", "path": "_path"})
        met = tier.join(over, (F.col("tree") == F.col("_tree")) & (F.col("up") == F.col("_up")))
        pairs = F.transform("kids", lambda kid, at: F.struct(kid.alias("kid"), F.concat(own(at), F.col("_path")).cast(PATH).alias("path")))
        reach = met.select("tree", *more, F.inline(pairs)).select("tree", *more, "kid.*", "path")
        if i:
            reach = reach.select("tree", *more, F.col("at").alias("up"), "path")
    return reach


def siblings(path: Column) -> Column:
    """The digests of the others under each parent, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.overlay(p["preimage"], F.lit(""), p["slot"] * DIGEST + 1, F.lit(DIGEST))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.overlay(p["preimage"], node, p["slot"] * DIGEST + 1, F.lit(DIGEST)), 256))


def manifest(leaves: DataFrame, *, source: str, order: Sequence[str]) -> DataFrame:
    """``leaves`` (with a column ``leaf``) and their ``subroot``, ``root`` and ``path`` to the root.

    Leaves of a source ascend by ``order`` and then by their digest, nulls
    first; sources ascend bytewise, null first. Repeated rows are leaves of
    their own. An empty table has no rows and no root.
    """
    keyed = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("tree"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("order"), F.col("leaf").alias("node"), F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row"))
    of_sources = build(_placed(cut(keyed), ["order", "node"], "row"))
    subroots = of_sources.tops.select(F.lit("").alias("tree"), F.col("tree").alias("row"), F.col("top").alias("node"))
    whole = build(_placed(cut(subroots), ["row"], "row"))
    root = whole.tops.select("tree", F.col("top").alias("root"), F.array().cast(PATH).alias("path"))
    above = paths(whole, root).select(F.col("row").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    return paths(of_sources, above).select("row.*", "subroot", "root", "path")


def _placed(nodes: DataFrame, order: Sequence[str], row: str) -> DataFrame:
    return running(nodes, group="tree", order=order, value=F.lit(1).cast("long")).select("tree", F.col("before").alias("at"), "node", F.col("total").alias("n"), row)


def checked(docs: DataFrame, *, tampered: Column, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every document's leaf, subroot, root and proof, and whether its text as it may have been tampered with still leads to the root.

    ``tampered`` gives a document's text as found now. The document is folded
    anew from that text and the original siblings. Null values have a form of
    their own in a leaf; other columns are not looked at.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    found = [tampered if c == text else F.col(f"`{c}`") for c in fields]
    leaves = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), leaf_of(columns).alias("leaf"), leaf_of(found).alias("now"))
    traced = manifest(leaves, source="source", order=["doc_id"])
    proved = traced.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.col("now"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Links within inverted lists, without writing out the pairs of a long list.

A list holds the nodes posted under one token. Short lists are expanded into
pairs. In long ones each node meets one hub, the node that is heaviest (whose
tokens are the commonest, as the original of a group of edited copies has them)
in most of its lists, and is known from then on by the few members in which its
set differs from the hub's. Nodes of one hub that land in different components
are compared by these differences alone: sets within the threshold have more
than half of a difference in common, so they meet under its rarest members.
What has no hub or different ones is compared under the lists' tokens. Every
link between components is found, whatever a list's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.components import components, merge_join
from rollbook.llm.scratch import cut

SHORT_LIST = 40  # lists up to this long are expanded into pairs
NEAR = 50  # per cent of its members that a set and its hub's have in common at least

Pairs = Callable[[DataFrame], DataFrame]
Alike = Callable[[Column, Column], Column]


def may_reach(percent: int) -> Column:
    """Whether sets a and b can reach the threshold: no more than ``s`` of a set's ``n`` members are in any other set."""
    return F.least("sa", "sb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _short(posts: DataFrame, percent: int) -> DataFrame:
    light = posts.where(F.col("df") <= SHORT_LIST)
    one = light.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    two = light.select(F.col("token").alias("token_b"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    return merge_join(one, two, (F.col("token") == F.col("token_b")) & (F.col("a") < F.col("b")) & may_reach(percent)).select("a", "b")


def _hubs(long: DataFrame) -> DataFrame:
    """``node`` and its ``hub``, the heaviest node in most of its lists (the heavier of equals)."""
    heads = long.groupBy(F.col("token").alias("_token")).agg(F.max(F.struct("weight", "node")).alias("head"))
    each = merge_join(long.select("token", "node"), heads, F.col("token") == F.col("_token")).groupBy("node", "head").agg(F.count("*").alias("lists"))
    return each.groupBy("node").agg(F.max(F.struct("lists", "head")).alias("most")).select("node", F.col("most.head.node").alias("hub"))


def _differences(hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, hub, n, nh (sizes of both sets) and ``delta``, the members that one of them alone has, for nodes near their hub."""
    one, two = sets.select(F.col("node").alias("_a"), F.col("hashes").alias("ha")), sets.select(F.col("node").alias("_b"), F.col("hashes").alias("hb"))
    both = merge_join(merge_join(hubs, one, F.col("node") == F.col("_a")), two, F.col("hub") == F.col("_b"))
    delta = F.concat(F.array_except("ha", "hb"), F.array_except("hb", "ha"))
    known = both.select("node", "hub", F.size("ha").cast("long").alias("n"), F.size("hb").cast("long").alias("nh"), delta.alias("delta"))
    shared = (F.col("n") + F.col("nh") - F.size("delta")) / 2
    return cut(known.where(shared * 100 >= F.greatest("n", "nh") * NEAR))


def _apart(percent: int, na: Column, nb: Column) -> Column:
    """Members that one of two sets alone has, at most, within the threshold."""
    return F.floor((na + nb) * (100 - percent) / (100 + percent))


def _by_differences(near: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of one hub and different components, at least one of them beyond the threshold from the hub.

    Of two differences of sizes p and q whose sets differ in t members at most,
    (p + q - t) / 2 members are common; so each meets the other under its
    rarest members but for one less than so many.
    """
    n, nh, p = F.col("n"), F.col("nh"), F.size("delta")
    known = found.select(F.col("node").alias("_node"), "comp")
    nodes = merge_join(near.where(F.size("delta") > 0), known, F.col("node") == F.col("_node"), "left").select("node", "hub", "n", "nh", "delta", F.coalesce("comp", "node").alias("comp"))
    nodes = cut(nodes.withColumn("far", p > _apart(percent, n, nh)))
    df = nodes.select(F.col("hub").alias("_hub"), F.explode("delta").alias("_member")).groupBy("_hub", "_member").agg(F.count("*").alias("df"))
    open_hubs = nodes.groupBy(F.col("hub").alias("_open")).agg(F.count_if("far").alias("n_far")).where("n_far > 0").select("_open")
    nodes = merge_join(nodes, open_hubs, F.col("hub") == F.col("_open"), "left_semi")
    each = nodes.select("node", "hub", F.explode("delta").alias("member"))
    ranked = merge_join(each, df, (F.col("hub") == F.col("_hub")) & (F.col("member") == F.col("_member"))).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "member"))).alias("ranked"))
    # the partner of a far node has at least half its difference in common with it; a far node, what it has more than the threshold allows
    widest = F.floor(n * 100 / percent)
    common_far = F.greatest(F.lit(1), p - _apart(percent, n, widest))
    common_any = F.greatest(F.lit(1), F.ceil((p + (nh - n) * (100 - percent) / (100 + percent) - 2) / 2))
    posts = merge_join(nodes, ranked.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")
    posts = posts.withColumns({"common_far": common_far.cast("int"), "common_any": common_any.cast("int"), "p": p})

    def posted(rows: DataFrame, common: str) -> DataFrame:
        prefix = F.filter(F.slice("ranked", F.lit(1), F.greatest(F.lit(0), F.col("p") - F.col(common) + 1)), lambda x: x["df"] > 1)
        return rows.select("hub", "node", "n", "comp", "far", "delta", F.explode(prefix).alias("x")).withColumn("member", F.col("x.member")).drop("x")

    one = posted(posts.where("far"), "common_far").toDF(*[c + "_a" for c in ("hub", "node", "n", "comp", "far", "delta", "member")])
    two = posted(posts, "common_any").toDF(*[c + "_b" for c in ("hub", "node", "n", "comp", "far", "delta", "member")])
    alone = F.size("delta_a") + F.size("delta_b") - 2 * F.size(F.array_intersect("delta_a", "delta_b"))
    fits = (F.col("member_a") == F.col("member_b")) & (F.col("hub_a") == F.col("hub_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.abs(F.size("delta_a") - F.size("delta_b")) <= _apart(percent, F.col("n_a"), F.col("n_b")))
    return merge_join(one, two, fits & (alone <= _apart(percent, F.col("n_a"), F.col("n_b")))).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _remaining(lists: DataFrame, percent: int, codes: DataFrame | None, alike: Alike | None) -> DataFrame:
    """All members outside their list's largest component against all members of other components and hubs; with ``codes``, those alike alone come out of the join."""
    if codes is not None:
        lists = merge_join(lists, codes.select(F.col("node").alias("_node"), "code"), F.col("node") == F.col("_node")).drop("_node")
    else:
        lists = lists.withColumn("code", F.lit(None))
    names = ("token", "node", "n", "s", "comp", "hub", "rest", "code")
    one = lists.where("rest").select(*names).toDF("token", "a", "na", "sa", "ca", "ha", "ra", "code_a")
    two = lists.select(*names).toDF("token_b", "b", "nb", "sb", "cb", "hb", "rb", "code_b")
    fits = (F.col("token") == F.col("token_b")) & (F.col("ca") != F.col("cb")) & (F.col("ha") != F.col("hb")) & may_reach(percent) & (~F.col("rb") | (F.col("a") < F.col("b")))
    if alike is not None:
        fits = fits & alike(F.col("code_a"), F.col("code_b"))
    return merge_join(one, two, fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open_lists(long: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """Long lists that are not yet of one component and one hub: token, node, n, s, comp, hub (its own where it is near none), and whether the member is outside the list's largest component."""
    known = found.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    members = merge_join(long, known, F.col("node") == F.col("_node"), "left").select("token", "node", "n", "s", F.coalesce("_comp", "node").alias("comp"))
    hubs = near.select(F.col("node").alias("_near"), F.col("hub").alias("_hub"))
    # a hub is none of the nodes' numbers where it stands for a node alone
    members = merge_join(members, hubs, F.col("node") == F.col("_near"), "left").select("token", "node", "n", "s", "comp", F.coalesce("_hub", -F.col("node") - 1).alias("hub"))
    sizes = members.groupBy("token", "comp").agg(F.count("*").alias("size"), F.min("hub").alias("h0"), F.max("hub").alias("h1"))
    most = sizes.groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"), F.count("*").alias("kinds"), F.min("h0").alias("h0"), F.max("h1").alias("h1")).where("kinds > 1 AND h0 <> h1").withColumnRenamed("token", "_token")
    return merge_join(members, most, F.col("token") == F.col("_token")).select("token", "node", "n", "s", "comp", "hub", (F.col("comp") != F.col("largest")).alias("rest"))


def _agreeing(pairs: DataFrame, codes: DataFrame | None, alike: Alike | None) -> DataFrame:
    if codes is None:
        return pairs.distinct()
    one, two = codes.select(F.col("node").alias("_a"), F.col("code").alias("code_a")), codes.select(F.col("node").alias("_b"), F.col("code").alias("code_b"))
    held = merge_join(pairs.distinct(), one, F.col("a") == F.col("_a"))
    return merge_join(held, two, (F.col("b") == F.col("_b")) & alike(F.col("code_a"), F.col("code_b"))).select("a", "b")


def link(posts: DataFrame, sets: DataFrame, confirmed: Pairs, *, percent: int, codes: DataFrame | None = None, alike: Alike | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join all of each component, and the component of each linked node.

    ``posts``: token, node, n (the size of the node's set), s (how many of its
    members other sets may have), weight and df (nodes under the token), with
    each node once under a token; nodes are not negative, or all are hashes.
    ``sets``: node and its members as ``hashes``. ``codes`` (node, code) and
    ``alike`` (of two codes) thin pairs out cheaply; ``confirmed`` writes those
    that hold.
    """
    long = posts.where(F.col("df") > SHORT_LIST).drop("df")
    links = confirmed(_agreeing(_short(posts, percent), codes, alike))
    near = _differences(_hubs(long), sets)
    to_hub = (F.col("node") != F.col("hub")) & (F.size("delta") <= _apart(percent, F.col("n"), F.col("nh")))
    links = cut(links.unionAll(near.where(to_hub).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))).distinct())
    found = components(links)
    more = cut(_by_differences(near, found, percent).unionAll(confirmed(_remaining(cut(_open_lists(long, found, near)), percent, codes, alike))))
    if more.isEmpty():
        return links, found
    links = cut(links.unionAll(more))
    return links, components(links)

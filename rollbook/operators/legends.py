"""Legends of vote tables: what each mark means, read from the document's own text. A text that is not wholly a legend is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.lattice import _let

DITTO = "〃"
COLON = "(.)：(.+?)(?=.：|$)"
QUOTED = "「([^」]+)」([^「]*)"


def _items(text: Column, pattern: str) -> Column:
    """Keys and meanings if the pattern's items make up the whole text, else none."""
    keys, meanings = (F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2))
    whole = (text != "") & (F.regexp_replace(text, pattern, "") == "")
    none = F.array().cast("array<struct<key: string, meaning: string>>")
    return F.when(whole, F.zip_with(keys, meanings, lambda k, m: F.struct(k.alias("key"), m.alias("meaning")))).otherwise(none)


def colon_items(text: Column) -> Column:
    """``○：賛成×：反対`` as pairs: a mark of one letter, a full-width colon, and all up to the next mark and colon."""
    return _items(F.trim(text), COLON)


def quoted_items(text: Column) -> Column:
    """``「○」賛成、「×」反対`` as pairs; a comma behind a meaning is not part of it."""
    return F.transform(_items(text, QUOTED), lambda p: F.struct(p["key"].alias("key"), F.regexp_replace(p["meaning"], "、$", "").alias("meaning")))


def expand_ditto(meaning: Column, first: Column) -> Column:
    """A meaning that begins with a ditto mark: the first meaning up to where its rest (the longest beginning of it of two letters or more that is found there) stands, and the rest. Null where nothing of it is found."""
    rest = F.substr(meaning, F.lit(2))
    longest = F.least(F.length(rest), F.length(first))
    tries = F.when(longest >= 2, F.sequence(longest, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    hit = F.get(F.filter(tries, lambda n: F.position(F.substr(rest, F.lit(1), n), first) > 1), F.lit(0))
    put = F.concat(F.substr(first, F.lit(1), F.position(F.substr(rest, F.lit(1), hit), first) - 1), rest)
    return F.when(meaning.startswith(DITTO), put).otherwise(meaning)


def legend(lines: DataFrame, items: Column, *, doc: str = "doc", at: str = "at", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs (doc, key, meaning) of documents' legend lines, and documents refused (entity, detail).

    A ditto mark points to the document's first meaning. A document is refused
    as a whole if one of its lines is no legend (only where ``strict``; else
    such lines are passed over), a key has no meaning, a ditto mark points
    nowhere, or a key appears twice: which of two meanings holds is not guessed.
    """
    # items are worked out once, in a generator; all that is asked of a document is then told within its row
    read = lines.select(F.col(doc).alias("doc"), F.col(at).alias("at"), F.explode(F.array(items)).alias("items"))
    docs = read.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "items"))).alias("_lines"))
    pairs = F.flatten(F.transform("_lines", lambda x: x["items"]))

    def told(of: Column) -> Column:
        """Each pair with its meaning spelt out: a ditto mark looks to the first meaning before it."""
        plain = F.transform(of, lambda p: (p["meaning"] != "") & ~p["meaning"].startswith(DITTO))
        at_first = F.array_position(plain, True)
        first = F.when(at_first > 0, F.get(of, (at_first - 1).cast("int"))["meaning"])
        return _let(F.struct(at_first.alias("at"), first.alias("meaning")), lambda f: F.transform(of, lambda p, i: F.struct(
            p["key"].alias("key"), F.when(~p["meaning"].startswith(DITTO), p["meaning"]).when(f["at"] - 1 < i, expand_ditto(p["meaning"], f["meaning"])).alias("meaning"))))

    read_through = docs.select("doc", "_lines", F.explode(F.array(_let(pairs, told))).alias("pairs"))
    keys = F.transform("pairs", lambda p: p["key"])
    twice = F.array_min(_let(F.sort_array(keys), lambda ks: F.filter(ks, lambda k, i: F.get(ks, i + 1) == k)))
    least = lambda holds: F.array_min(F.transform(F.filter("pairs", holds), lambda p: p["key"]))
    faults = [F.when(F.exists("_lines", lambda x: F.size(x["items"]) == 0), "a line is no legend")] if strict else []
    faults += [F.concat(F.lit(what), c) for what, c in (("no meaning of ", least(lambda p: p["meaning"] == "")), ("nothing for the ditto mark of ", least(lambda p: p["meaning"].isNull())), ("twice ", twice))]
    judged = read_through.select("doc", "pairs", F.explode(F.array(F.coalesce(*faults))).alias("detail"))
    good = judged.where("detail IS NULL").select("doc", F.explode("pairs").alias("p")).select("doc", "p.key", "p.meaning")
    return good, judged.where("detail IS NOT NULL").select(F.col("doc").alias("entity"), "detail")

"""Groups so large that what makes pairs of them does not end in time."""

import random
import re
import time

from pyspark.sql import functions as F

from rollbook.operators import districts, matching, resolve

T = resolve.Terms(ends="ends", pos="pos")
MANY = 30_000


def crowd(spark):
    """One name that everybody bears: the first in office in session 5 with group A, others in office before, up to a date or not."""
    ends = F.when(F.col("id") % 3 == 0, F.format_string("2001-%02d-01", F.col("id") % 12 + 1)).otherwise("")
    first = F.col("id") == 0
    return spark.range(MANY).select(
        F.col("id").alias("member"), F.lit("name").alias("key"), F.when(first, 5).otherwise(1).alias("since"), F.when(first, 5).otherwise(2).alias("until"),
        F.when(first, "A").otherwise("B").alias("grp"), F.when(first, "").otherwise(ends).alias("ends"), F.lit(0).alias("pos"))


def test_many_members_and_records_of_one_name(spark):
    asked = spark.range(MANY).select("id", F.lit("name").alias("name"), F.lit(5).alias("at"), F.when(F.col("id") % 2 == 0, "A").otherwise("C").alias("grp"), F.format_string("200%d-06-15", F.col("id") % 3 + 1).alias("day"))
    began = time.perf_counter()
    got = resolve.resolve(asked, crowd(spark), record="id", key="name", at="at", group="grp", date="day", t=T)
    found = {(r.day, r.grp, r.member, r.branch): r["count"] for r in got.groupBy("day", "grp", "member", "branch").count().collect()}
    assert time.perf_counter() - began < 60
    # in June of 2001 thousands are over, of whom none has the group A
    each = MANY // 6
    assert found == {
        ("2001-06-15", "A", 0, "group"): each, ("2001-06-15", "C", None, "ambiguous"): each, ("2002-06-15", "A", 0, "single"): each, ("2002-06-15", "C", 0, "single"): each,
        ("2003-06-15", "A", 0, "single"): each, ("2003-06-15", "C", 0, "single"): each,
    }


def test_names_listed_many_times(spark):
    bills = spark.range(MANY).select("id", F.array(F.lit("name"), F.lit("other")).alias("names"), F.lit(5).alias("sess"), F.lit("2001-06-15").alias("day"))
    began = time.perf_counter()
    got = matching.mentions(bills, crowd(spark).drop("grp").withColumn("grp", F.lit("")), record="id", names=F.col("names"), at="sess", date="day", t=T)
    assert {(r.name, r.branch, r["count"]) for r in got.groupBy("name", "branch").count().collect()} == {("name", "ambiguous", MANY), ("other", "none", MANY)}
    assert time.perf_counter() - began < 60


def plainly(record, terms, aliases):
    """Every term of the name looked at for one record."""
    _, at, group, day = record
    held = {}
    for member, since, until, grp, ends, pos in terms:
        until = since if until is None else until
        if since <= at:
            held.setdefault(member, []).append((at <= until, 0 if at <= until else until, -pos, grp, ends))
    people = []
    for member, of in held.items():
        direct = any(c for c, *_ in of)
        over = day is not None and any(not c and ends and ends >= day for c, *_, ends in of)
        then = max(of)[3]
        if direct or over:
            people.append((member, direct, group is not None and (then == group or (then, group) in aliases)))
    same = [(m, d) for m, d, s in people if s]
    direct = [m for m, d in same if d]
    if not people:
        return None, "none"
    if len(people) == 1:
        return people[0][0], "single"
    if len(same) == 1:
        return same[0][0], "group"
    return (direct[0], "direct") if len(same) > 1 and len(direct) == 1 else (None, "ambiguous")


def test_running_sums_give_what_pairs_give(spark):
    draw = random.Random(7)
    days = [None, *[f"200{y}-0{m}-01" for y in range(3) for m in (1, 5)]]
    terms = [(m, draw.randint(1, 6), draw.choice([None, *range(1, 8)]), draw.choice("ABC"), draw.choice(["", *days[1:]]), p) for m in range(12) for p in range(draw.randint(0, 3))]
    asked = [(i, draw.randint(0, 9), draw.choice([None, "A", "B", "C", "D"]), draw.choice(days)) for i in range(400)]
    for few in (terms, terms[:5], terms[:2]):
        side = spark.createDataFrame([(m, "n", *rest) for m, *rest in few], "member int, key string, since int, until int, grp string, ends string, pos int")
        records = spark.createDataFrame([(i, "n", *rest) for i, *rest in asked], "id int, name string, at int, grp string, day string")
        same = spark.createDataFrame([("A", "D"), ("B", "D")], "roster_group string, record_group string")
        got = resolve.resolve(records, side, record="id", key="name", at="at", group="grp", date="day", t=T, same_group=same)
        assert {r.id: (r.member, r.branch) for r in got.collect()} == {r[0]: plainly(r, few, {("A", "D"), ("B", "D")}) for r in asked}


def test_many_units_of_one_prefecture(spark):
    many = 6_000
    munis = spark.range(many).select(F.col("id").alias("code"), F.lit("県").alias("pref"), F.concat(F.lit("郡"), F.format_string("%05d", "id"), F.lit("町村あいうえおかきくけこさしすせそたちつてと市")).alias("city"))
    units = munis.select("pref", F.lit(1).alias("number"), F.when(F.col("code") % 3 == 0, F.col("city")).when(F.col("code") % 3 == 1, F.concat(F.lit("〓"), F.substr("city", F.lit(2)))).otherwise(F.substr("city", F.lit(3))).alias("unit"), F.lit(False).alias("partial"))
    renames = spark.createDataFrame([], "pref string, former string, name string, partial boolean")
    began = time.perf_counter()
    got = {(r.tier, r.hits): r["count"] for r in districts.match_units(units, munis, renames).groupBy("tier", "hits").count().collect()}
    assert got == {(1, 1): 2 * many // 3, (4, 1): many // 3}
    assert time.perf_counter() - began < 45


def test_units_fit_as_patterns_do(spark):
    """Held against every pattern tried on every name."""
    draw = random.Random(3)
    word = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    munis = spark.createDataFrame([(i, draw.choice("pq"), word(draw.randint(0, 5), "郡a𠮷町")) for i in range(150)], "code int, pref string, city string")
    units = spark.createDataFrame([(draw.choice("pq"), draw.randint(1, 2), word(draw.randint(0, 4), "郡a𠮷町〓_%"), draw.random() < 0.3) for _ in range(200)] + [("p", 1, None, False)], "pref string, number int, unit string, partial boolean")
    renames = spark.createDataFrame([("p", "a町", "a", True), ("q", "〓", "町町", None)], "pref string, former string, name string, partial boolean")
    got = sorted((r.pref, r.number, r.unit, r.partial, r.code, r.tier, r.hits) for r in districts.match_units(units, munis, renames).collect())
    names, former, best = munis.collect(), renames.collect(), {}
    for u in [u for u in units.collect() if u.unit is not None]:
        like = re.compile("".join("." if c in "_〓" else ".*" if c == "%" else re.escape(c) for c in u.unit), re.S)
        tail = re.compile(".*" + like.pattern, re.S)
        found = best.setdefault((u.pref, u.number, u.unit), [])
        for m in [m for m in names if m.pref == u.pref]:
            tier = 1 if like.fullmatch(m.city) else 3 if u.unit[-1:] in ("町", "村") and like.fullmatch(re.sub("^.*?郡", "", m.city)) else 4 if tail.fullmatch(m.city) else None
            found += [(u.partial, m.code, tier)] if tier else []
            found += [(u.partial or bool(r.partial), m.code, 2) for r in former if (r.pref, r.former, r.name) == (u.pref, u.unit, m.city)]
    want = []
    for own, found in best.items():
        kept = [f for f in found if f[2] == min(x[2] for x in found)]
        want += [(*own, *f, len(kept)) for f in kept]
    assert got == sorted(want)


def test_many_patterns_of_one_brand(spark):
    many = 12_000
    names = spark.range(many).select(F.lit("B").alias("brand"), F.format_string("%05d lemon", "id").alias("name"))
    asked = names.select("brand", F.col("name").alias("own"), F.when(F.crc32("name") % 2 == 0, F.concat(F.lit("_"), F.substr("name", F.lit(2)))).otherwise(F.substr("name", F.lit(3))).alias("pattern")).where("own < '00300 '")
    every = asked.unionByName(spark.range(many).select(F.lit("B").alias("brand"), F.format_string("x%05d", "id").alias("own"), F.format_string("x%05d_", "id").alias("pattern")))
    began = time.perf_counter()
    got = {(r.own, r.name, r.whole) for r in districts.fitting_ends(every, names, pattern="pattern", name="name", within="brand").collect()}
    assert time.perf_counter() - began < 40
    pool = [f"{i:05d} lemon" for i in range(many)]
    want = {(r.own, n, len(n) == len(r.pattern)) for r in asked.collect() for n in pool if re.fullmatch(".*" + r.pattern.replace("_", "."), n)}
    assert got == want and len(got) > 300

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollbook.operators import resolve, terms

TERM = "member string, key string, since int, until int, grp string, ends string, pos int"
RECORD = "id int, name string, at int, grp string, day string"
T = resolve.Terms(ends="ends", pos="pos")

CASES = {
    # name: (terms, record (at, group, day), member, branch)
    "unique": ([("a", 217, 220, "Y", ""), ("a", 221, 221, "X", "")], (221, "X", "2025"), "a", "single"),
    "unique of another group": ([("a", 221, 221, "X", "")], (221, "Z", "2025"), "a", "single"),
    "only later": ([("a", 222, 223, "X", "")], (221, "X", "2025"), None, "none"),
    "group decides": ([("a", 221, 221, "A", ""), ("b", 221, 221, "B", "")], (221, "B", "2025"), "b", "group"),
    "alias decides": ([("a", 221, 221, "A", ""), ("b", 221, 221, "B", "")], (221, "old A", "2025"), "a", "group"),
    "one not yet in office": ([("a", 222, 222, "B", ""), ("b", 219, 221, "B", "")], (221, "B", "2025"), "b", "single"),
    "both fit": ([("a", 221, 221, "A", ""), ("b", 221, 221, "A", "")], (221, "A", "2025"), None, "ambiguous"),
    "none of the group": ([("a", 221, 221, "A", ""), ("a", 217, 220, "C", ""), ("b", 221, 221, "B", "")], (221, "C", "2025"), None, "ambiguous"),
    "carried over": ([("a", 216, 216, "A", "2026-07-28")], (221, "A", "2026-06-05"), "a", "single"),
    "term ended": ([("a", 216, 216, "A", "2026-01-28")], (221, "A", "2026-06-05"), None, "none"),
    "end unknown": ([("a", 216, 216, "A", "")], (221, "A", "2026-06-05"), None, "none"),
    "no date": ([("a", 216, 216, "A", "2027-01-01")], (221, "A", None), None, "none"),
    "direct before carried": ([("a", 216, 216, "A", "2027-01-01"), ("b", 221, 221, "A", "")], (221, "A", "2026-01-01"), "b", "direct"),
    "open end is one session": ([("a", 220, None, "A", "")], (221, "A", "2026-01-01"), None, "none"),
    "no group given": ([("a", 221, 221, "A", ""), ("b", 221, 221, "B", "")], (221, None, "2025"), None, "ambiguous"),
}


def test_cascade(spark):
    rows, records, want = [], [], {}
    for n, (name, (ts, (at, g, day), member, branch)) in enumerate(CASES.items()):
        rows += [(f"{m}", name, a, z, grp, ends, i) for i, (m, a, z, grp, ends) in enumerate(ts)]
        records.append((n, name, at, g, day))
        want[n] = (member, branch)
    records.append((999, None, 221, "A", "2025"))
    want[999] = (None, "none")
    same = spark.createDataFrame([("A", "old A")], "roster_group string, record_group string")
    for seed in (7, 13, 42):
        shuffled = spark.createDataFrame(rows, TERM).orderBy(F.rand(seed)).repartition(3)
        got = resolve.resolve(spark.createDataFrame(records, RECORD), shuffled, record="id", key="name", at="at", group="grp", date="day", t=T, same_group=same)
        assert {r.id: (r.member, r.branch) for r in got.collect()} == want


def test_two_tiers(spark):
    roster = spark.createDataFrame([("a", "N1", 1, 9, "", "", 0), ("b", "N2", 5, 5, "", "", 0), ("c", "N3", 1, 9, "", "", 0), ("d", "N4", 1, 9, "", "", 0)], TERM)
    kana = spark.createDataFrame([("a", "k1", 1, 9, "", "", 0), ("b", "k2", 5, 5, "", "", 0), ("c", "k3", 1, 9, "", "", 0), ("d", "k3", 1, 9, "", "", 0)], TERM)
    posts = spark.createDataFrame([(1, "N1", "k9", 3), (2, "N2", "k1", 3), (3, None, "k1", 3), (4, "other", "k3", 3), (5, "other", "k2", 3)], "id int, name string, kana string, at int")
    got = resolve.resolve_two_tier(posts, roster, kana, record="id", key="name", second_key="kana", at="at", t=resolve.Terms(group=None))
    assert {r.id: (r.member, r.matched_by, r.reason) for r in got.collect()} == {
        1: ("a", "name", None), 2: (None, None, "no-candidate"), 3: ("a", "second", None), 4: (None, None, "ambiguous"), 5: (None, None, "no-candidate"),
    }


def test_name_matching(spark):
    roster = spark.createDataFrame([("m1", "山田太郎"), ("m2", "山本一郎"), ("m3", "田中"), ("m4", "山田次郎太郎")], "id string, full string")
    asked = spark.createDataFrame([(1, "山太"), (2, "田中"), (3, "本"), (4, "山田太郎"), (5, "山本"), (6, None)], "n int, cut string")
    sub = {r.n: (r.member, r.hits) for r in resolve.match_names(asked, roster, key="cut", roster_key="full", member="id", how="subsequence").collect()}
    assert sub == {1: (None, 2), 2: ("m3", 1), 3: (None, 0), 4: ("m1", 1), 5: ("m2", 1), 6: (None, 0)}
    head = {r.n: r.member for r in resolve.match_names(asked, roster, key="cut", roster_key="full", member="id", how="prefix").collect()}
    assert head == {1: None, 2: "m3", 3: None, 4: "m1", 5: "m2", 6: None}
    pairs = resolve.one_letter_apart(spark.createDataFrame([("a", "abc"), ("b", "abd"), ("c", "xbd"), ("d", "ab"), ("e", "abc")], "id string, n string"), name="n", member="id").collect()
    assert {(r.member, r.member_b) for r in pairs} == {("a", "b"), ("e", "b"), ("b", "c")}


def test_group_of_no_term_and_repeats(spark):
    matched = spark.createDataFrame([(1, 1, "a", "X"), (2, 1, "a", "Z"), (3, 2, None, "Z"), (4, 2, "b", None)], "id int, call int, member string, grp string")
    roster = spark.createDataFrame([("a", "k", 1, 1, "X", "", 0), ("b", "k", 1, 1, "Y", "", 0)], TERM)
    assert {r.id for r in resolve.group_mismatches(matched, roster, group="grp").collect()} == {2, 4}
    assert [(r.call, r.member, r.times) for r in resolve.repeated_members(matched, call="call").collect()] == [(1, "a", 2)]


ROSTERS = st.lists(st.tuples(st.integers(1, 6), st.sampled_from("ab"), st.sampled_from("XY")), max_size=14, unique_by=lambda x: x[:2])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROSTERS)
def test_merged_terms(spark, rows):
    df = spark.createDataFrame(rows, "session int, member string, grp string")
    got = {(r.member, r.grp, r.since, r.until, r.current) for r in terms.merge_terms(df, member="member", session="session", same=["grp"]).collect()}
    published = sorted({s for s, _, _ in rows})
    want = set()
    for m in {m for _, m, _ in rows}:
        run = None
        for i, s in enumerate(published):
            g = next((g for t, n, g in rows if (t, n) == (s, m)), None)
            if run and (g != run[1] or run[3] != published[i - 1]):
                want.add((m, run[1], run[2], run[3], run[3] == published[-1]))
                run = None
            if g:
                run = (m, g, run[2] if run else s, s)
        if run:
            want.add((m, run[1], run[2], run[3], run[3] == published[-1]))
    assert got == want


@pytest.mark.parametrize("at, want", [(5, "B"), (3, "A"), (4, "A"), (9, "B"), (1, None)])
def test_term_in_force(spark, at, want):
    t = spark.createDataFrame([("m", 2, 3, "A", 1), ("m", 5, None, "B", 0), ("m", 5, 5, "C", 2)], "who string, a int, z int, grp string, pos int")
    got = terms.term_in_force(spark.createDataFrame([(1, "m", at)], "id int, member string, at int"), t, record="id", member="member", at="at", value="grp", term_member="who", since="a", until="z", pos="pos").collect()
    assert [r.grp for r in got] == ([want] if want else [])

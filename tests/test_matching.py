from pyspark.sql import functions as F

from rollbook.operators import matching, quality, resolve, terms, timeline

TERM = "member string, key string, since int, until int, grp string, ends string, pos int, house string"
T = resolve.Terms(ends="ends", pos="pos")
ROSTER = [("a", "Ito", 217, 221, "X", "", 0, "up"), ("b", "Ito", 217, 221, "Y", "", 0, "low"), ("c", "Mori", 217, 219, "X", "", 0, "up"), ("d", "Ono", 221, 221, "X", "", 0, "low")]
BILL = "id string, session int, day string, house string, kind string, names array<string>, ids array<string>"
BILLS = [
    ("b1", 221, "2025-01-01", "up", "own", ["Ito", "Ono", None, "Mori"], ["old"]),
    ("b2", 218, "2024-01-01", "low", "own", ["Ono", "Ito", "Ito"], None),
    ("b3", 100, "1990-01-01", "low", "own", ["Ito"], ["kept"]),
    ("b4", 221, "", "up", "own", ["Ito"], None),
    ("b5", 221, "2025-01-01", "up", "own", [], ["old"]),
    ("b6", 221, "2025-01-01", "up", "own", None, None),
]


def test_listed_names_by_house(spark):
    roster, bills = spark.createDataFrame(ROSTER, TERM), spark.createDataFrame(BILLS, BILL)
    covered = terms.covered_sessions(roster, since="since", until="until")
    found = matching.mentions(bills, roster, record="id", names=F.col("names"), at="session", date="day", house="house", t=T, covered=covered)
    got = sorted((r.record, r.place, r.name, r.member, r.branch) for r in found.collect())
    assert got == [
        ("b1", 0, "Ito", "a", "single"), ("b1", 1, "Ono", None, "none"), ("b1", 3, "Mori", None, "none"),
        ("b2", 0, "Ono", None, "none"), ("b2", 1, "Ito", "b", "single"), ("b2", 2, "Ito", "b", "single"), ("b4", 0, "Ito", "a", "single"),
    ]
    lists = {r.id: r.ids for r in matching.with_members(bills, found, record="id", out="ids", at="session", covered=covered).collect()}
    assert lists == {"b1": ["a"], "b2": ["b", "b"], "b3": ["kept"], "b4": ["a"], "b5": None, "b6": None}
    assert {r.id: r.ids for r in matching.with_members(bills, found, record="id", out="ids").collect()}["b3"] is None
    assert [r.entity for r in matching.undated(bills, record="id", names=F.col("names"), date="day").collect()] == ["b4"]


def test_names_of_both_houses_need_a_group(spark):
    roster = spark.createDataFrame(ROSTER, TERM)
    said = spark.createDataFrame([("s1", 218, "d", "Ito", "Y", None), ("s2", 218, "d", "Ito", None, ""), ("s3", 218, "d", "Clerk", None, "secretary"), ("s4", 218, "d", None, None, None)], "id string, session int, day string, speaker string, grp string, position string")
    found = matching.mentions(said, roster, record="id", names=F.array("speaker"), at="session", date="day", group="grp", t=T, keep=["position"])
    assert {r.record: (r.member, r.branch) for r in found.collect()} == {"s1": ("b", "group"), "s2": (None, "ambiguous"), "s3": (None, "none")}
    assert [r.record for r in matching.unmatched(found, unless=F.col("position") != "").collect()] == ["s2"]
    assert matching.unmatched(found).count() == 2


def test_roles_fold_over_sittings(spark):
    roster = spark.createDataFrame(ROSTER, TERM)
    sat = spark.createDataFrame([("m1", 218, "2024-02-01", "chair", ["Mori"]), ("m2", 218, "2024-01-01", "chair", ["Mori", "Nobody"]), ("m3", 219, "2024-05-01", "chair", ["Mori"])], "id string, session int, day string, role string, names array<string>")
    found = matching.mentions(sat, roster, record="id", names=F.col("names"), at="session", date="day", t=T, keep=["role", "day", "session"])
    roles = timeline.fold_roles(found.where("member IS NOT NULL"), ["member", "role", "session"], order=["day"], carry=["day"])
    assert sorted((r.member, r.session, r.times, r.first_day, r.last_day) for r in roles.collect()) == [("c", 218, 2, "2024-01-01", "2024-02-01"), ("c", 219, 1, "2024-05-01", "2024-05-01")]
    assert matching.mentions(sat.limit(0), roster, record="id", names=F.col("names"), at="session", t=T).count() == 0


def test_ids_that_no_name_attests(spark):
    roster, bills = spark.createDataFrame(ROSTER, TERM), spark.createDataFrame(BILLS, BILL)
    covered = terms.covered_sessions(roster, since="since", until="until")
    found = matching.mentions(bills, roster, record="id", names=F.col("names"), at="session", date="day", house="house", t=T, covered=covered)
    rows = matching.unattested(bills, found, record="id", ids="ids", at="session", covered=covered)
    assert sorted((r.record, r.names, r.ids, r.attested, r.unattested) for r in rows.collect()) == [("b1", 3, 1, 1, ["old"]), ("b5", 0, 1, 0, ["old"])]
    assert tuple(matching.attestation(bills, ids="ids", at="session", covered=covered).first()) == (2, 1)


def test_quarantine_files_and_sources(spark):
    rows = spark.createDataFrame([(1, "a", "Ito", None), (2, None, "Ono", "g"), (3, "", "Ono", None), (4, None, "Mori", None)], "id int, member string, name string, grp string")
    listed = spark.createDataFrame([("Ono", "g"), ("Mori", None)], "name string, grp string")
    assert [r.entity for r in quality.not_quarantined(rows, "id", "member", ["name", "grp"], listed).collect()] == [3]
    files, index = spark.createDataFrame([("a",), ("b",)], "f string"), spark.createDataFrame([("a",), ("c",)], "p string")
    assert [r.entity for r in quality.orphans(files, "f", index, "p").collect()] == ["b"]
    urls = spark.createDataFrame([(1, "https://up.example/x", "up"), (2, "http://up.example/x", "up"), (3, None, "up"), (4, "https://else.example", "up"), (5, "https://Low.example:80/", "up"), (6, "https://low.example?q", "low"), (7, "https://low.example", None)], "id int, url string, house string")
    hosts = spark.createDataFrame([("up.example", "up"), ("low.example", "low")], "host string, house string")
    got = {r.entity: r.detail for r in quality.bad_source(urls, "id", "url", hosts, by="house").collect()}
    assert got == {2: "no https source", 3: "no https source", 4: "host else.example", 5: "other house low.example", 7: "other house low.example"}
    assert sorted(r.entity for r in quality.bad_source(urls, "id", "url", hosts).collect()) == [2, 3, 4]
    counts = spark.createDataFrame([(1, 5), (3, 5), (2, 4)], "session int, n int")
    assert tuple(quality.best_covered(counts, session="session", n="n").first()) == (3, 5)
    assert tuple(quality.best_covered(counts.limit(0), session="session", n="n").first()) == (None, None)

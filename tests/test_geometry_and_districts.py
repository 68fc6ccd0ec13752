from pyspark.sql import functions as F

from rollbook.operators import districts, geometry

ITEM = "doc string, page int, str string, x double, y double, w double, h double"


def page():
    """Three members, two motions, in a ruled grid of letters ten units wide; y grows upwards."""
    xs, ys = [0.0, 100.0, 120.0, 140.0, 160.0], [300.0, 250.0, 225.0, 200.0]
    items = []

    def put(text, col, row, step=8.0, down=False):
        x, y = xs[col] + 5, (ys[row] + ys[row + 1]) / 2
        for i, c in enumerate(text):
            items.append(("d", 1, c, x + (0 if down else i * step), (ys[row] - 12 - i * step) if down else y, 6.0, 0.0))

    for col, name in enumerate(("甲乙", "丙", "丁戊"), 1):
        put(name, col, 0, down=True)
    put("予算案", 0, 1)
    put("条例", 0, 2)
    for col, mark in enumerate("○×○", 1):
        put(mark, col, 1)
    for col, mark in enumerate("○○欠", 1):
        put(mark, col, 2)
    # one border drawn twice
    vlines = [("d", 1, x + d, 200.0, 300.0) for x in xs for d in ((0.0, 0.8) if x == 120 else (0.0,))]
    hlines = [("d", 1, y, 0.0, 160.0) for y in ys]
    return items, vlines, hlines


def test_vote_table_whatever_the_order(spark):
    items, vlines, hlines = page()
    legend = spark.createDataFrame([("○", "yes"), ("×", "no")], "raw string, mapped string")
    for seed in (7, 13):
        got = geometry.vote_table(
            spark.createDataFrame(items, ITEM).orderBy(F.rand(seed)), spark.createDataFrame(vlines, "doc string, page int, x double, y0 double, y1 double").orderBy(F.rand(seed)),
            spark.createDataFrame(hlines, "doc string, page int, y double, x0 double, x1 double"), legend,
        ).collect()
        assert {(r.title, r.name, r.raw, r.mapped) for r in got} == {
            ("予算案", "甲乙", "○", "yes"), ("予算案", "丙", "×", "no"), ("予算案", "丁戊", "○", "yes"), ("条例", "甲乙", "○", "yes"), ("条例", "丙", "○", "yes"), ("条例", "丁戊", "欠", None),
        }


def test_clusters_bands_and_anchors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.4, 10.0, 10.5],), ([],), ([5.0],)], "v array<double>")
    assert [r.c for r in df.select(geometry.cluster(F.col("v")).alias("c")).collect()] == [[1.5, 3.4, 10.25], [], [5.0]]
    got = spark.createDataFrame([(0.5,), (1.5,), (10.0,), (19.5,), (15.0,), (None,)], "v double").select(geometry.band_index([0, 10, 20], F.col("v")).alias("b")).collect()
    assert [r.b for r in got] == [None, 0, None, None, 1, None]
    items = spark.createDataFrame([("p", 1, 0.0), ("p", 2, 5.0), ("q", 3, 0.0)], "page string, item int, at double")
    anchors = spark.createDataFrame([("p", "a", -1.0), ("p", "b", 1.0), ("p", "c", 6.0)], "page string, anchor string, pos double")
    near = {r.item: r.anchor for r in geometry.nearest(items, anchors, by=["page"], item="item", at="at", anchor="anchor", anchor_at="pos").collect()}
    assert near == {1: None, 2: "c"}
    lines = spark.createDataFrame([("d", 1, 5.0, 0.0, 10.0), ("d", 1, 5.2, 9.0, 20.0), ("d", 1, 5.1, 40.0, 50.0)], "doc string, page int, x double, y0 double, y1 double")
    assert {(r.y0, r.y1) for r in geometry.merged_segments(lines, at="x", low="y0", high="y1").collect()} == {(0.0, 20.0), (40.0, 50.0)}
    text = spark.createDataFrame([("d", 1, "下", 0.0, 0.0, 5.0, 10.0), ("d", 1, "上", 0.0, 30.0, 5.0, 10.0), ("d", 1, "中", 0.0, 20.0, 5.0, 10.0)], ITEM)
    assert geometry.vertical_text(text, ["doc", "page"]).first().text == "上中 下"


def test_districts(spark):
    postal = spark.createDataFrame(
        [("01", "1000001", "東京都", "三宅島三宅村"), ("02", "1000002", "東京都", "西多摩郡奥多摩町"), ("03", "1000003", "東京都", "千代田区"), ("04", "1000003", "神奈川県", "横浜市"), ("05", "1000005", "静岡県", "浜松市中央区"), ("06", "1000006", "東京都", "青ヶ島村")],
        "code string, zip string, pref string, city string",
    )
    units = spark.createDataFrame(
        [("東京都", 1, "千代田区", True), ("東京都", 10, "千代田区", True), ("東京都", 2, "三宅村", False), ("東京都", 25, "奥多摩町", False), ("東京都", 3, "青〓島村", False), ("神奈川県", 1, "横浜市", False), ("静岡県", 7, "浜松市中区", False), ("静岡県", 8, "どこか", False)],
        "pref string, number int, unit string, partial boolean",
    )
    renames = spark.createDataFrame([("静岡県", "浜松市中区", "浜松市中央区", False)], "pref string, former string, name string, partial boolean")
    munis = districts.municipalities(postal)
    matched = districts.match_units(units, munis, renames)
    assert {(r.unit, r.tier) for r in matched.collect()} == {("千代田区", 1), ("三宅村", 4), ("奥多摩町", 3), ("青〓島村", 1), ("横浜市", 1), ("浜松市中区", 2)}
    assert [r.unit for r in districts.unplaced_units(units, matched).collect()] == ["どこか"]
    resolved = districts.municipality_districts(munis, matched)
    assert districts.incomplete(resolved).count() == 0
    got = {r.zip: (r.districts, r.municipalities) for r in districts.districts_by_zip(postal, resolved).collect()}
    assert got["1000003"] == (["東京1", "東京10", "神奈川1"], ["東京都千代田区", "神奈川県横浜市"]) and got["1000005"][0] == ["静岡7"]
    twice = postal.unionAll(spark.createDataFrame([("01", "9", "東京都", "別名")], postal.schema))
    assert [r.code for r in districts.conflicting_codes(twice).collect()] == ["01"]

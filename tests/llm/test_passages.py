import random
import re
import string

from pyspark.sql import functions as F

from rollbook.llm import passages

RNG = random.Random(3)
UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(n, tag):
    return [f"{tag}{RNG.randrange(10**7)}" for _ in range(n)]


def line(n, tag="w"):
    return " ".join(words(n, tag))


SHARED, INSIDE, NEAR = line(60, "s"), line(55, "i"), words(80, "n")
ROWS = [
    (1, line(70) + "\n" + SHARED + "\n" + line(40)),
    (2, SHARED + "\n" + line(90)),
    # in the midst of other words
    (3, line(150) + " " + INSIDE + " " + line(100)),
    (4, "a b c\n" + line(33) + " " + INSIDE + " " + line(200)),
    # a line with one word of eighty changed
    (5, line(30) + "\n" + " ".join(NEAR)),
    (6, " ".join([*NEAR[:20], "other", *NEAR[21:]]) + "\n" + line(30)),
    # brief lines repeat innocently
    (7, "all rights reserved by us\n" + line(100)),
    (8, "all rights reserved by us\n" + line(100)),
    # repeats within one text
    (9, SHARED.upper().lower() + "\n" + line(30)),
    (10, "z " * 400),
    (11, None), (12, ""), (13, " \n\n\t"), (14, "one"),
    (None, line(26) + "\n" + SHARED),
    (15, "é 😀 " + line(200)), (16, line(40)),
]


def test_repeats_go_and_clean_texts_stay(spark):
    docs = spark.createDataFrame([(i, t, 4, "k") for i, t in ROWS], "doc_id long, text string, h int, _x string").repartition(3)
    got = {r.doc_id: r for r in passages.removed(docs).collect()}
    assert len(got) == len(ROWS) and got[1].h == 4
    touched = {i for i, r in got.items() if r._spans}
    assert touched == {2, 4, 6, 9, None}
    assert got[2]._keepers == [1] and got[4]._keepers == [3] and got[6]._keepers == [5] and got[None]._keepers == [1]
    for i, t in ROWS:
        if i not in touched:
            assert got[i]._clean == t and got[i]._keepers == []
    assert got[2]._clean == dict(ROWS)[2].split("\n")[1]
    assert INSIDE not in got[4]._clean and got[4]._clean.startswith("a b c\n") and got[4]._clean.endswith(dict(ROWS)[4][-1500:])
    # at most the passage's edges, less than ``EVERY`` words at either end, are left
    left = [w for w in got[4]._clean.split() if w in set(INSIDE.split())]
    assert len(left) < 2 * passages.EVERY
    assert passages.removed(docs.limit(0)).count() == 0


def test_every_copy_of_fifty_words_shares_a_passage(spark):
    for n in range(50, 62):
        shared = line(n, "p")
        docs = spark.createDataFrame([(1, line(RNG.randrange(80)) + " " + shared + " " + line(70)), (2, line(RNG.randrange(80)) + " " + shared + " " + line(50))], "doc_id long, text string")
        found = passages.units(docs, id_col="doc_id", text_col="text").select("id", F.inline("seeds")).groupBy("node").agg(F.countDistinct("id").alias("docs")).where("docs = 2")
        assert found.count() > 0


def test_cutting_out():
    cut = passages._cut_out
    assert cut("a b c\nd e f\ng h", [(3, 6)]) == "a b c\ng h"
    assert cut("a b c\nd e f", [(0, 3)]) == "d e f"
    assert cut("a b c", [(0, 2), (1, 3)]) == ""


def test_passages_run_over_line_breaks(spark):
    shared = words(60, "b")
    wrapped = ["\n".join(" ".join(shared[i : i + n]) for i in range(0, 60, n)) for n in (9, 13)]
    docs = spark.createDataFrame([(1, line(30) + "\n" + wrapped[0] + "\n" + line(30)), (2, line(40) + " " + wrapped[1] + " " + line(50)), (3, line(80))], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.removed(docs).collect()}
    assert got[1]._spans == got[3]._spans == 0 and got[2]._keepers == [1]
    assert len(got[2]._clean) < len(got[2].text)


def test_no_word_of_a_repeat_is_left(spark):
    rows, shared = [], {}
    for n in (50, 51, 55, 60, 77, 120, 200):
        shared[n] = words(n, "q")
        rows += [(n, line(RNG.randrange(1, 60)) + " " + " ".join(shared[n]) + " " + line(45)), (1000 + n, line(RNG.randrange(1, 60)) + " " + " ".join(shared[n]) + " " + line(35))]
    for r in passages.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id < 1000:
            assert r._clean == r.text and r._spans == 0
        else:
            planted = set(shared[r.doc_id - 1000])
            assert r._clean.split() == [w for w in r.text.split() if w not in planted]
            assert r._spans == 1 and r._keepers == [r.doc_id - 1000]


def test_edited_passages_go(spark):
    rows, shared = [], {}
    for k, (n, kind) in enumerate((n, kind) for n in (50, 60, 61, 100, 140) for kind in ("other", "less", "more")):
        held = words(n, "e")
        edits = [n // 2] if n < 100 else [n // 3, 2 * n // 3]
        near = [w if i not in edits else {"other": "x", "less": "", "more": w + " x"}[kind] for i, w in enumerate(held)]
        shared[k + 1] = {*held, "x"}
        rows += [(k + 1, line(40) + " " + " ".join(held) + " " + line(45)), (1001 + k, line(33) + " " + " ".join(w for w in near if w) + " " + line(35))]
    # nothing is widened over more than the threshold allows
    far = words(24, "f") + words(24, "g")
    rows += [(500, line(40) + " " + " ".join(far)), (501, line(50) + " " + " ".join(far[:24] + words(12, "h") + far[24:]) + " " + line(30))]
    got = {r.doc_id: r for r in passages.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, of_k in shared.items():
        assert got[k]._spans == 0 and got[1000 + k]._keepers == [k]
        assert got[1000 + k]._clean.split() == [w for w in got[1000 + k].text.split() if w not in of_k]
    assert got[501]._clean.split() == [w for w in got[501].text.split() if w not in set(far)]


def test_no_run_of_fifty_words_stays_in_two_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    split = {i: [w.translate(UPPER) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for i, t in texts.items()}
    gone = {i: [False] * len(w) for i, w in split.items()}
    for r in passages.repeats(docs).collect():
        gone[r.id][r.start : r.end] = [True] * (r.end - r.start)
    assert any(map(any, gone.values()))
    held = {}
    for i, w in split.items():
        for a in range(len(w) - 49):
            if not any(gone[i][a : a + 50]):
                assert held.setdefault(tuple(w[a : a + 50]), i) == i


def test_a_seed_elsewhere_hides_no_passage(spark):
    shared = words(60, "k")
    # each piece of 20 words stands in some earlier document by itself
    rows = [(i, line(30) + " " + " ".join(shared[i * 4 : i * 4 + 20]) + " " + line(30)) for i in range(11)]
    rows += [(100 + i, line(30) + " " + " ".join(shared) + " " + line(30)) for i in range(3)]
    got = {r.doc_id: r for r in passages.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]._spans == 0 for i in [*range(11), 100])
    for i in (101, 102):
        assert got[i]._keepers == [100] and got[i]._clean.split() == [w for w in got[i].text.split() if w not in set(shared)]


def test_lines_at_the_threshold_share_a_band(spark):
    rows = []
    for i in range(1000):
        # 45 words, 41 shingles; the first word or words changed: (41 - 4) / (41 + 4) is 0.82
        held = words(45, "t")
        rows += [(i, " ".join(held)), (10000 + i, " ".join(words(4, "t") + held[4:]))]
    found = passages.units(spark.createDataFrame(rows, "doc_id long, text string"), id_col="doc_id", text_col="text").select("id", F.inline("lines"))
    bands = found.select((F.col("id") % 10000).alias("pair"), "id", F.explode("bands").alias("band"))
    met = bands.groupBy("pair", "band").agg(F.countDistinct("id").alias("docs")).where("docs = 2").select("pair").distinct().count()
    assert met >= 998

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.llm import decontam, registry

SF = "/root/testdata/sf0.001"


def least_distance(item, text):
    """Plain dynamic programming over all parts of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=12), st.text("abc ", max_size=30))
def test_myers_equals_dynamic_programming(item, text):
    if text:
        assert min(decontam.myers(item, text)) == least_distance(item, text)


def test_every_item_within_its_budget_is_found():
    rng = random.Random(4)
    item = "".join(rng.choice("abcdefgh ") for _ in range(100)).strip()
    finder = decontam.Finder([decontam.normal(item)])
    k = finder.allowed[0]
    for trial in range(200):
        edits = trial % (k + 3)
        letters = list(finder.items[0])
        for _ in range(edits):
            at = rng.randrange(len(letters))
            rng.choice([lambda: letters.pop(at), lambda: letters.insert(at, "z"), lambda: letters.__setitem__(at, "q")])()
        text = decontam.normal("".join(rng.choice("xyz ") for _ in range(60)) + " " + "".join(letters) + " " + "".join(rng.choice("xyz ") for _ in range(60)))
        want = least_distance(finder.items[0], text)
        got = finder.find(text)
        assert bool(got) == (want <= k) and (not got or got[0][1] == want)
        if got:
            _, distance, start, end = got[0]
            assert least_distance(finder.items[0], text[start:end]) == distance


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x " + item.upper() + " y", 0), (3, item.replace("fox", "fax"), 0), (None, item, 0), (4, "z" * 50000, 0)], "doc_id long, text string, distance int")
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "brief", "x"), (5, item, "x")], "item_id int, text string, start string")
    got = sorted(((r.doc_id or 0, r.item_id, r.distance) for r in decontam.leaks(docs, items).collect()))
    assert got == [(0, 1, 0), (0, 5, 0), (3, 1, 0), (3, 1, 1), (3, 5, 0), (3, 5, 1)]
    split = sorted(((r.doc_id or 0, r.item_id, r.distance) for r in decontam.leaks(docs, items, index_chars=60).collect()))
    assert split == got
    clean = decontam.clean_documents(docs, items)
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 4] and clean.columns == docs.columns
    assert decontam.leaks(docs.limit(0), items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0 and decontam.clean_documents(docs, items.limit(0)).count() == 6


def test_whole_table_against_brute_force(spark):
    docs = [(r.doc_id, decontam.normal(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, decontam.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in registry.op5_decontaminate(spark, SF).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            if t:
                least = min(decontam.myers(x, t))
                if least <= int(len(x) * decontam.EDITS):
                    want[d, i] = least
    assert got == want


def test_brief_items_are_words_of_their_own(spark):
    docs = spark.createDataFrame([(1, "The answer is x42y."), (2, "It is  X42, they say"), (3, "q"), (4, "a brief item here")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "x42"), ("r", "Q"), ("s", "brief itam here")], "item_id string, text string")
    assert sorted((r.doc_id, r.item_id, r.distance, r.start) for r in decontam.leaks(docs, items).collect()) == [(2, "p", 0, 6), (3, "r", 0, 0), (4, "s", 1, 2)]

import random
import re

import pytest

from rollbook.llm import components, linking, neardup, registry

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=4, percent=80):
    """(n_shingles, component) of each row, components by the place of their first row in (null id last, id) order."""
    sets = [shingles(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first.setdefault(root(i), []).append(d)
    least = {r: min(ds, key=lambda d: (d is None, d or 0)) for r, ds in first.items()}
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def noisy(words, edits, rng):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def fixture_rows():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (8, "z " * 30000)]
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(200)]
        rows += [(100 * (g + 1) + i, noisy(words, i % 5, rng)) for i in range(12)]
    # one long list: every text a near copy of one, each different
    words = [f"h{i}" for i in range(150)]
    rows += [(1000 + i, noisy(words, 3, rng)) for i in range(90)]
    # copies with words left out and changed, some within the threshold of the original, some of each other alone
    words = [f"k{i}" for i in range(120)]
    rows += [(3000 + i, noisy([w for w in words if rng.random() > i % 7 / 100], i % 4, rng)) for i in range(150)]
    # a common beginning, different endings: long lists of many components
    rows += [(2000 + i, " ".join(words[:60] + [f"t{i // 2}u{j}" for j in range(20)])) for i in range(120)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, fixture_rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in fixture_rows], "doc_id long, text string, n int, key string").repartition(5)
    got = neardup.near_duplicates(docs, width=4, percent=80).collect()
    assert sorted(((r.id, r.n, r.first_id) for r in got), key=str) == sorted(brute(fixture_rows), key=str)
    assert sum(r.first for r in got) == len({(r.first_id, r.id, r.uid) for r in got if r.first})
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.op3_near_duplicates(spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(70, 71), (71, 70), (5, 5)], "a long, b long")
    got = {r.node: r.comp for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 70: 70, 71: 70}
    assert components.components(links.limit(0)).count() == 0
    rng = random.Random(8)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(500 + i, 500 + j) for i in range(20) for j in range(i)]
    least = {}
    for x in sorted({v for p in pairs for v in p if p[0] != p[1]}):
        seen, open_ = set(), [x]
        while open_:
            at = open_.pop()
            if at not in seen:
                seen.add(at)
                open_ += [q if p == at else p for p, q in pairs if at in (p, q)]
        least[x] = min(seen)
    assert {r.node: r.comp for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == least


def test_long_lists_lose_no_link(spark):
    n = linking.SHORT_LIST * 3
    posts = spark.createDataFrame([("t", i, 10, 10, 0, n) for i in range(n)], "token string, node long, n long, s long, weight long, df long")
    # only nodes of the same remainder are alike: a star from one hub finds one of seven components
    none = spark.createDataFrame([], "node long, hashes array<long>")
    links, found = linking.link(posts, none, lambda pairs: pairs.where("a % 7 = b % 7"), percent=80)
    assert {r.node: r.comp for r in found.collect()} == {i: i % 7 for i in range(n)}

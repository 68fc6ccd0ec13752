import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rollbook.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, at long, path string, tree int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def climb(levels, at, now):
    proof = []
    for nodes in levels[:-1]:
        run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
        proof += run[: at % 3] + run[at % 3 + 1 :]
        now = h("".join(run[: at % 3] + [now] + run[at % 3 + 1 :]))
        at //= 3
    return proof, now


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for at, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            a, now = climb(trees[s], at, leaf((*r[:4], text)))
            b, now = climb(top, i, now)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h("".join(a + b)), now, now == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 5, "y", 1) for r in rows], SCHEMA).repartition(5)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = merkle.checked(docs, tampered=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=str)


ODD = [
    (1, "b", "en", 3, "a\nb"), (2, "b", None, None, None), (3, None, "de", 0, ""), (4, None, "de", 5, "\n\n"), (5, "", "x", 1, "é\n😀"), (5, "", "x", 1, "é\n😀"),
    (5, "", "x", 1, "other"), (None, "b", "x", 1, "no id\n"), (9, "Ω", "x", 70000, "z\n" * 35000), (10, "a", None, None, None),
]


def test_odd_rows(spark):
    assert run(spark, ODD) == brute(ODD)
    assert run(spark, ODD[:1]) == brute(ODD[:1])
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [81, 82, 300])
def test_heights(spark, n):
    """A source of a whole block, of one leaf more and of several tiers, beside small ones; as many sources as fill two tiers."""
    rows = [(i, "hot", "en", i, f"text\n{i}") for i in range(n)] + [(1000 + i, f"s{i % 90}", "en", i, f"t{i}\n") for i in range(100)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}

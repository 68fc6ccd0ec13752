import hashlib

from pyspark.sql import functions as F

from rollbook.llm import registry, sketch

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
ROWS = [
    (5, " ".join(WORDS)), (1, None), (9, ""), (7, "Ab cd"), (8, "ab\t cd"), (3, "x"), (3, "y"), (None, "null id"), (6, "z" * 70000),
    (10, " ".join(WORDS)), (4, "é😀 " * 50), (11, " ".join(WORDS[:200])),
]


def edited(rows):
    out = []
    for at, (i, t) in enumerate(rows):
        t, n = t or "", rows[(at + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    return out


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, fingerprint string").repartition(3)
    got = sketch.fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    # equal ids are ordered by text hash: either order of the two is possible
    a = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    b = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, -ord((r[1] or "-")[0])))
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) in (sorted(map(str, edited(a))), sorted(map(str, edited(b))))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[10].fingerprint and by[7].fingerprint == by[8].fingerprint
    assert by[1].fingerprint == by[9].fingerprint == "="
    assert by[7].near_next == 1.0 and by[9].near_next == 0.0
    # the last half of the longer one is not in the shorter, all of the shorter is in the longer
    assert 0.3 < by[10].near_next < 0.7 and by[11].held_edited > 0.5
    assert sketch.fingerprints(docs.limit(0)).count() == 0
    one = sketch.fingerprints(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0 and one.n_chars == len(ROWS[0][1])


def shingles(text, width=5):
    words = text.translate(str.maketrans(sketch._UPPER, sketch._LOWER)).split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_every_edit_and_likeness_on_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in registry.op2_document_fingerprints(spark, SF).collect()}
    assert [(r.doc_id, *edited([(x.doc_id, x.text) for x in rows])[at][1:]) for at, r in enumerate(rows)] == [(i, got[i].n_chars, got[i].edited_sha256) for i in (r.doc_id for r in rows)]
    off = []
    for at, r in enumerate(rows):
        nxt = rows[(at + 1) % len(rows)].text
        q = len(r.text) // 4
        a, b = shingles(r.text), shingles(r.text[: len(r.text) - q] + nxt[:q])
        off.append(abs(got[r.doc_id].near_edited - len(a & b) / len(a | b)))
    assert sum(off) / len(off) < 0.1


def test_sketches_merge(spark):
    t = spark.createDataFrame([("g", " ".join(WORDS[:250])), ("g", " ".join(WORDS[200:]))], "g string, text string")
    parts = t.select("g", sketch.sketch(F.col("text"))["kept"].alias("kept"))
    whole = t.select(sketch.sketch(F.lit(" ".join(WORDS)))["kept"].alias("kept")).first().kept
    assert set(sketch.merged(parts, ["g"]).first().kept) == set(whole)

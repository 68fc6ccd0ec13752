import math
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import functions as F

from rollbook.llm import langid, registry

SF = "/root/testdata/sf0.01"


def test_probabilities_of_every_context_sum_to_one(spark):
    rows = spark.createDataFrame([(1, "abab abba", "x"), (2, "cdcd ddc", "y")], "doc_id long, text string, lang string")
    model = langid.train(rows, least=1)
    p = 2.0 ** (-model.table.astype(float) * langid.UNIT)
    assert abs(p.reshape(-1, model.width, 2).sum(1) - 1).max() < 0.02
    bits = model.lengths([b"abab", b"cdcd", b""])
    assert bits[0, 0] < bits[0, 1] and bits[1, 1] < bits[1, 0] and (bits[2] == 0).all()
    # blocks do not change a text's code length
    many = model.lengths([b"abab " * 1000] * 500)
    assert (many == many[0]).all()


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 !?", None), (4, "abab", "x"), (4, "abab", "x"), (None, "cdcd" * 9000, None)], "doc_id long, text string, lang string")
    model = langid.train(spark.createDataFrame([(1, "abab", "x"), (2, "cdcd", "y")], rows.schema))
    got = sorted((r.doc_id or 0, r.lang_pred, 0 <= r.score <= 1) for r in langid.predict(rows, model).collect())
    assert got == [(0, "y", True), (1, "und", True), (2, "und", True), (3, "und", True), (4, "x", True), (4, "x", True)]
    assert sorted(r.doc_id or 0 for r in langid.known_languages(rows, model).collect()) == [0, 4, 4]
    nothing = langid.train(rows.limit(0))
    assert {r.lang_pred for r in langid.predict(rows, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = registry.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 300 and right > 0.97


def plain_bits(grams, text, order, least):
    """Code lengths by prediction by partial matching in dictionaries: one recursion over contexts, without tables or rounding."""
    labels = sorted({label for label, _ in grams})
    used = sorted({b for _, g in grams for b in g})
    fold = lambda b: b if b in used else None
    counts, held = defaultdict(Counter), Counter()
    for (label, g), n in grams.items():
        for k in range(order + 1):
            counts[label, g[order - k : order]][g[order]] += n
            held[g[order - k : order]] += n

    def probabilities(label, context):
        if context is None:
            return dict.fromkeys([*used, None], 1 / (len(used) + 1))
        shorter = probabilities(label, context[1:] if context else None)
        seen = counts[label, context]
        if not seen:
            return shorter
        whole, rest = sum(seen.values()) + len(seen), sum(p for b, p in shorter.items() if b not in seen)
        return {b: seen[b] / whole if b in seen else len(seen) / whole * p / rest for b, p in shorter.items()}

    out = []
    for label in labels:
        bits, past = 0.0, tuple(b" " * order)
        for b in text:
            context = past
            while context and held[context] < least:
                context = context[1:]
            bits -= math.log2(probabilities(label, tuple(context))[fold(b)])
            past = (*past, fold(b))[-order:]
        out.append(bits)
    return labels, out


def test_code_lengths_against_plain_dictionaries():
    learnt = {"en": "the cat sat on the mat and the dog ate the rat that sat there " * 2, "de": "der hund und die katze sassen auf der matte und die ratte " * 2, "xx": "zzzz"}
    order = 3
    for least in (1, 8):
        grams = Counter()
        for label, text in learnt.items():
            data = b" " * order + text.encode()
            for i in range(len(text)):
                grams[label, tuple(data[i : i + order + 1])] += 1
        rows = [(label, int.from_bytes(bytes(g), "big"), n) for (label, g), n in grams.items()]
        model = langid.Model(pd.DataFrame(rows, columns=["label", "gram", "n"]), order, least)
        for text in ("the rat", "die matte", "zz", "Qé quite else", "", "t" * 300):
            labels, want = plain_bits(grams, text.encode(), order, least)
            got = model.lengths([text.encode()])[0]
            assert labels == list(model.labels)
            assert all(abs(a - b) <= len(text.encode()) / 1024 + 1e-6 for a, b in zip(got, want, strict=True)), (text, got, want)


def test_counts_of_grams(spark):
    docs = spark.createDataFrame([("a", "abcab"), ("b", "é"), ("b", "")], "_label string, _text string").repartition(3)
    got = {(r.label, r.gram): r.n for r in langid.gram_counts(docs, 2).collect()}
    code = lambda s: int.from_bytes(s, "big")
    assert got[("a", code(b"  a"))] == 1 and got[("a", code(b"cab"))] == 1 and got[("b", code(b"  \xc3"))] == 1
    assert sum(n for (label, _), n in got.items() if label == "a") == 5

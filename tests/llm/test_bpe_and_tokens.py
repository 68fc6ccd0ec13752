import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rollbook.llm import bpe, registry, scratch, tokenfile
from rollbook.llm.wordcode import default_vocabulary, read_vocabulary

TEXT = read_vocabulary(default_vocabulary())
LIB = Tokenizer.from_str(TEXT)
OURS = bpe.Bpe(TEXT)
ROWS = [
    (3, "The cat's  whiskers — it'll DO"), (1, None), (2, ""), (2, ""), (9, "x" * 5000), (5, "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>"),
    (7, "Σίσυφος ΣΑΣ İstanbul ﬁ ½ e\u0301 12345 \u2003 tab\tend\x1fsplit\x1c"), (8, "日本語 テスト😀😀 \x00 \ufeff"), (None, "null id"), (11, "ab " * 3000),
]


def expected(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [r[1] for r in ROWS])
def test_ids_and_decoding_equal_the_library(text):
    ids = OURS.encode(text)
    assert ids == expected(text)
    assert OURS.decode(ids) == LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeth' \n\t.,<|>ÉèßΣ12'sS\u0301"), st.characters(exclude_categories=("Cs", "Cn"), max_codepoint=0x2FFF)), max_size=60))
def test_any_text_equals_the_library(text):
    assert OURS.encode(text) == expected(text)


def test_pair_tree_takes_the_leftmost_of_lowest_rank():
    pairs = {1 << 32 | 1: (0, 2), 2 << 32 | 2: (1, 3)}
    assert bpe.PairTree([1] * 5, dict(pairs)).merged() == [3, 1]
    assert bpe.PairTree([7, 8], {}).merged() == [7, 8]


def test_documents(spark):
    docs = spark.createDataFrame([(i, t, 4, "x") for i, t in ROWS], "doc_id long, text string, n_tokens int, ids string")
    got = bpe.encode_documents(docs, default_vocabulary()).collect()
    want = []
    for i, t in ROWS:
        ids = expected(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(docs.limit(0), default_vocabulary()).count() == 0


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 4) for i, t in ROWS], "doc_id long, text string, start int").repartition(3)
    path = scratch.new_path(spark, "tokens")
    got = tokenfile.token_file(docs, path, default_vocabulary(), end_id=2).orderBy("start").collect()
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*expected(t), 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    kept = spark.read.parquet(path)
    assert kept.where("doc_id = 3").select("ids").first()[0] == [*expected(ROWS[0][1]), 2]
    empty = tokenfile.token_file(docs.limit(0), scratch.new_path(spark, "tokens"), default_vocabulary(), end_id=2)
    assert empty.count() == 0


def test_whole_table_equals_the_library(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    coded = {i: LIB.encode(t, add_special_tokens=False) for i, t in rows}
    start, want = 0, {}
    for i, _ in rows:
        want[i] = (start, len(coded[i].ids) + 1, zlib.crc32(np.array([*coded[i].ids, 2], "<u4").tobytes()))
        start += len(coded[i].ids) + 1
    assert {r.doc_id: tuple(r)[1:] for r in registry.op7_token_file(spark, "/root/testdata/sf0.001").collect()} == want
    for r in registry.op10_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = coded[r.doc_id].ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_layout_of_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} and {i} more " * 40) for i in range(6000)], "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(docs, path, default_vocabulary(), end_id=2)
    seen = 0
    for file in tmp_path.glob("tokens/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                chunk = meta.row_group(g).column(c)
                assert chunk.has_offset_index and chunk.compression == "ZSTD"
                if chunk.path_in_schema.startswith("ids"):
                    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(chunk.encodings)
                    seen += chunk.num_values
                else:
                    assert chunk.has_column_index
    assert seen == spark.read.parquet(path).selectExpr("sum(n_tokens)").first()[0]
    # lengths alone leave the ids unread, and a range of ids is pushed to the pages
    plan = spark.read.parquet(path).where("doc_id BETWEEN 10 AND 12").select("n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema: ")[1].split("\n")[0] and "GreaterThanOrEqual(doc_id,10)" in plan


def test_caches_stay_within_their_room():
    coder = bpe.Bpe(TEXT).coder
    coder.room = coder.words_left = coder.pieces_left = 20_000
    for i in range(2000):
        text = f"piece{i} word{i % 9}."
        assert np.frombuffer(coder.encode(text), np.uint32).tolist() == expected(text)
        held = [*coder.words, *coder.old_words, *coder.pieces, *coder.old_pieces]
        assert len(held) * 190 < 4 * 21_000


def test_words_are_remembered_once_and_never_taken_for_special_tokens():
    coder, asked = bpe.Bpe(TEXT).coder, []
    inner = coder.code_word
    coder.code_word = lambda word: asked.append(word) or inner(word)
    for text in ("river", "river, (River) RIVER.", "a<b <b a<", "été Été, été.", "<<", "x<<y"):
        assert np.frombuffer(coder.encode(text), np.uint32).tolist() == expected(text)
    # a word's ids serve the piece that is that word, and the other way round
    assert asked.count("river") == 1 and "river" in coder.pieces and "river" not in coder.words

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import token_files
from lodestrata.llm.common import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part string, start int"


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\t 　ab'sé.,!1²<|>"), st.characters(blacklist_categories=("Cs",))), max_size=40))
def test_pieces_encode_as_the_whole(text):
    enc = token_files.encoder(PATH, special_as_text=True)
    enc.cache.clear()
    assert "".join(enc.pieces(text)) == text
    assert np.frombuffer(enc.encode([text])[0], dtype=enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def expect(rows, whole):
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole(text or "") + [0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def order(rows):
    return sorted(rows, key=lambda r: r[1])


def test_documents(spark, whole):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    got = [tuple(r) for r in token_files.op4_token_files(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert order(got) == expect(list(zip(docs.doc_id, docs.text)), whole)


def test_edges_and_random_access(spark, whole):
    rows = [(3, None), (1, ""), (2, "<|endoftext|> a   b \n c"), (2, "<|endoftext|> a   b \n c"), (None, "x"), (7, "long word " * 9000), (-5, "é" * 10)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    parts = token_files.write_tokens(df, PATH, new_path(spark, "t"), length=8, special_as_text=True)
    got = order([tuple(r) for r in token_files.read_documents(parts).collect()])
    assert got == expect(rows, whole)
    ids = []
    for p in parts.orderBy("part").collect():
        f = token_files.SequenceFile(p.ids_file)
        n = 0
        for i in range(-(-p.n_tokens // 8)):
            seq, mask = f.sequence(i)
            assert len(seq) == 8
            n += mask.sum()
            ids += seq[mask].tolist()
        assert n == p.n_tokens
    assert ids == [x for _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for x in whole(text or "") + [0]]
    assert token_files.read_documents(token_files.write_tokens(df.limit(0), PATH, new_path(spark, "t"))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "ab", "é.", "\n"]), max_size=8).map("".join))
def test_special_strings_as_the_untouched_library(text):
    enc = token_files.encoder(PATH)
    enc.cache.clear()
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode([text])[0], dtype=enc.dtype).tolist() == want


def test_a_doc_id_of_many_rows_lies_in_several_parts(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(7, f"x <|endoftext|> y {i}") for i in range(400)] + [(i, "a b") for i in range(20)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = token_files.write_tokens(df.repartition(8), PATH, new_path(spark, "t"), length=16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.agg({"n_docs": "max"}).first()[0] < 200
    got = sorted((tuple(r) for r in token_files.read_documents(parts).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(i for i, _ in rows) and [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    assert sorted(r[3] for r in got) == sorted(zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()) for _, x in rows)
    f = token_files.SequenceFile(parts.first().ids_file)
    before = pa.total_allocated_bytes()
    ids, mask = f.mapped(1)
    assert pa.total_allocated_bytes() == before and len(ids) == len(mask) == 16 and mask.true_count == 16


class Counting(dict):
    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)


def test_distinct_words_are_looked_up_and_parts_encoded_once():
    enc = token_files.PieceEncoder(PATH)
    enc.cache, enc.spaced = Counting(), Counting()
    given, tokenizer = [], enc.tokenizer

    class Recorder:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    enc.tokenizer = Recorder()
    texts = ["zzqx qqvw, qqvw.\nWxyq qqvw###  zzqx!\n\nqqvw's 4.5% " * 50 + str(i) for i in range(40)]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype=enc.dtype).tobytes() for t in texts]
    assert enc.encode(texts) == want == enc.encode(pa.array(["", *texts]))[1:] == enc.encode(pa.array([*texts[:3], *texts]).slice(3))
    assert enc.spaced.asked + enc.cache.asked < 500
    assert sum(x.count("qqvw") for x in given) <= 4 and len("".join(given)) < 400


def test_a_full_cache_keeps_the_present_words(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 20)
    enc = token_files.PieceEncoder(PATH)
    for k in range(30):
        texts = [f"ab{i}, cd{i * k}.\nEf{k}  <|endoftext|> x" if i % 5 == 0 else f" ab{i}; cd{i * k}.\nEf{k}   gh \n {i}" for i in range(k)]
        assert enc.encode(texts) == [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, dtype=enc.dtype).tobytes() for t in texts]
    assert len(enc.spaced) + len(enc.cache) < 300


def test_a_letter_or_digit_ends_a_token_before_a_mark():
    t = Tokenizer.from_file(PATH)
    every = pa.array([chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    own = every.filter(pa.compute.utf8_is_alnum(every)).to_pylist() + [c for c in every.to_pylist() if c.isalnum()]
    assert all(len(t.pre_tokenizer.pre_tokenize_str(c + ".")) == 2 for c in set(own))

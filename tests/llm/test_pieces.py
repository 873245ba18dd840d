import zlib

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import pieces

MODEL = pieces.piece_model(pieces.model_path())


def every(text):
    """All segmentations of a whole text, by their scores; no cuts."""
    t = pieces.MARK + text.replace(" ", pieces.MARK)
    ways = [[] for _ in range(len(t) + 1)]
    ways[0] = [(0.0, ())]
    for z in range(1, len(t) + 1):
        for a in range(z):
            if t[a:z] in MODEL.id_of:
                i = MODEL.id_of[t[a:z]]
                ways[z] += [(s + MODEL.score[i], (*p, i)) for s, p in ways[a]]
            elif z == a + 1:
                ids = tuple(MODEL.bytes_id[b] for b in t[a].encode())
                ways[z] += [(s + MODEL.unknown, p + ids) for s, p in ways[a]]
    return sorted(ways[-1], reverse=True)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="the ané\n日.", min_size=1, max_size=9), st.integers(1, 6))
def test_n_best_against_all_segmentations(text, n):
    want = every(text)
    got = MODEL.n_best(text, n)
    assert [s for s, _ in got] == [s for s, _ in want[:n]]
    for s, ids in got:
        assert (s, tuple(ids)) in set(want) and MODEL.decode(ids) == text
    assert len({tuple(ids) for _, ids in got}) == len(got)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n▁ab"), st.characters(blacklist_categories=("Cs",))), max_size=30))
def test_decoding(text):
    ids = np.frombuffer(MODEL.encode(text)[0], dtype=np.int32).tolist()
    assert MODEL.decode(ids) == text.replace(pieces.MARK, " ")
    other = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert MODEL.decode(other.encode(text)) == text.replace(pieces.MARK, " ")


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    got = pieces.op3_sentence_pieces(spark, d).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{d}/documents.parquet").set_index("doc_id")
    assert len(got) == len(docs) and got.exact.all()
    for i, text in docs.text.head(40).items():
        best = MODEL.n_best(text, 4)
        assert got.score[i] == best[0][0] and list(got.nbest_scores[i]) == [s for s, _ in best]
        assert got.ids_crc32[i] == zlib.crc32(np.array(best[0][1], dtype="<i4").tobytes())
        assert got.n_pieces[i] == len(best[0][1])


def test_edges(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, " ", "s"), (3, "x" * 3000 + " y" * 20000, "s"), (3, "a", "s"), (3, "a", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode_pieces(df, pieces.model_path()).collect()
    assert [(r.n_pieces, r.score, r.exact) for r in got[:2]] == [(0, 0.0, True)] * 2 and all(r.exact for r in got)
    assert len(got) == 6 and got[4] == got[5]
    assert pieces.encode_pieces(df.limit(0), pieces.model_path()).collect() == []
    assert pytest.approx(got[2].score) == MODEL.n_best(" ", 1)[0][0]


def test_ties_do_not_widen_the_search():
    for text in ("=" * 5000, "ab" * 4000, "ha" * 3000 + "!" * 3000):
        best = MODEL.n_best(text, 4)
        assert len(best) == 4 and best[0][0] >= best[3][0] and all(MODEL.decode(ids) == text for _, ids in best)


def test_long_runs_that_no_piece_joins():
    for text in ("1234567890" * 500, "\n" * 5000, "黑暗森林" * 1250, "a" + "12" * 2500 + "the"):
        data, found = MODEL.encode(text, 4)
        ids = np.frombuffer(data, dtype=np.int32)
        assert MODEL.decode(ids) == text and found[0][0] == MODEL._nbest(pieces.MARK + text, 1)[0][0]
        assert [s for s, _ in found] == [s for s, _ in MODEL._nbest(pieces.MARK + text, 4)]
        assert ids.tolist() == list(MODEL._nbest(pieces.MARK + text, 1)[0][1])
    assert all(len(s) <= pieces.LONGEST_CACHED for s in MODEL.cache if "\n\n" in s)

import math
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.llm import sentencepiece_unigram as su
from skyloom.llm import textkit as tk
from tests.llm.common import DOCS, ODD, docs, prose

PATH = "/opt/tokenizers/piece_bpe_32k.model"
needs_file = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")

PIECES = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "c", "ab", "abc", "▁a", "▁ab", "bc", "ca", "é", "▁▁", "▁▁▁"]
SCORES = [0.0, *([0.0] * 256), -3.0, -2.0, -2.5, -2.2, -3.1, -4.0, -2.4, -3.9, -3.3, -3.0, -5.0, -3.5, -4.2]
SMALL = su.Vocabulary(PIECES, SCORES, list(range(1, 257)), {0})


def brute(v, pieces, text):
    """Viterbi by dictionaries over the whole text."""
    if not text:
        return []
    s = " " + text
    use = {pieces[i].replace(su.MARKER, " "): i for i in set(v.trie.value.tolist()) if i >= 0}
    longest = max(map(len, use))
    best, via = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        arcs = [(j, v.scores[use[s[i:j]]], [use[s[i:j]]]) for j in range(i + 1, min(len(s), i + longest) + 1) if s[i:j] in use]
        if not any(j == i + 1 for j, _, _ in arcs):
            arcs.append((i + 1, v.unknown, [int(v.bytes[b]) for b in s[i].encode()]))
        for j, c, ids in arcs:
            if best[i] + c > best[j]:
                best[j], via[j] = best[i] + c, (i, ids)
    out, at = [], len(s)
    while at:
        at, ids = via[at]
        out = ids + out
    return out


def encode(v, texts):
    data, offsets = tk.text_buffer(pa.array(texts, pa.string()))
    ids, bounds = su.encode_slice(v, data, offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc é▁\nx\U0001f600", max_size=14), max_size=6))
def test_small_vocabulary_against_dictionaries(texts):
    got = encode(SMALL, texts)
    assert got == [brute(SMALL, PIECES, t) for t in texts]
    assert [su.decode(SMALL, x) for x in got] == texts


@needs_file
def test_public_vocabulary_against_dictionaries_and_round_trip():
    import sentencepiece

    v = su.load(PATH)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    texts = [t for t in ODD if t is None or len(t) < 1000] + ["Hello  world,\n\nthis is 東京.", "  a", "▁", prose(1, 50)]
    got = encode(v, texts)
    assert got == [brute(v, pieces, t) for t in texts]
    assert [su.decode(v, x) for x in got] == [t or "" for t in texts]
    # The library's own decoder reads the same text from the pieces.
    assert sp.decode(got[-1]) == texts[-1]


def test_remembered_chunks_change_nothing(monkeypatch):
    monkeypatch.setattr(su.Known, "LIMIT", 40)
    known, texts = su.Known(), [prose(i % 7, 30) + " abc" * (i % 3) for i in range(25)]
    for t in texts:
        data, offsets = tk.text_buffer(pa.array([t]))
        ids, bounds = su.encode_slice(SMALL, data, offsets, known)
        assert ids[bounds[0] : bounds[1]].tolist() == brute(SMALL, PIECES, t)


@needs_file
def test_frames(spark):
    texts = [*ODD, "a", "a"]
    got = su.decoded(su.encode(docs(spark, texts), PATH), PATH).orderBy("id").collect()
    assert [r.text for r in got] == [t or "" for t in texts]
    assert got[-1].ids == got[-2].ids and got[0].ids == []
    assert su.encode(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_double_array_holds_exactly_its_keys():
    keys = [bytes([a, b][: 1 + (a + b) % 2]) for a in range(1, 60) for b in range(3)]
    keys = sorted(set(keys))
    t = su.DoubleArray(keys, list(range(len(keys))))
    for key, i in zip(keys, range(len(keys))):
        s = 0
        for c in key:
            to = t.base[s] + c
            assert t.check[to] == s
            s = to
        assert t.value[s] == i
    assert sum(x >= 0 for x in t.value) == len(keys)


def test_markers_inside_pieces_are_refused():
    with pytest.raises(ValueError):
        su.Vocabulary(["a▁b"], [0.0], [])


def test_scores_are_log_probabilities():
    ranks = [0.0, -3.0, -1.0, -1e9, -2.0, 0.0]
    got = su.log_scores(ranks, [1, 2, 3, 4, 5])
    assert got[0] == 0 and sum(math.exp(x) for x in got[1:]) == pytest.approx(1)
    assert got[5] > got[2] > got[4] > got[1] > got[3]
    assert su.log_scores([-1.5, -2.25, -7.0], [0, 1, 2]) == [-1.5, -2.25, -7.0]


@needs_file
def test_no_less_likely_than_the_merges():
    import sentencepiece

    v, sp = su.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [prose(i, 60) + " The quick brown foxes; naturally, unbelievable things." for i in range(30)]
    byte = set(v.bytes.tolist())
    score = lambda ids: sum(v.unknown if i in byte else v.scores[i] for i in ids)
    for text, own in zip(texts, encode(v, texts)):
        theirs = sp.encode(text)
        assert score(own) >= score(theirs) - 1e-6 and len(own) < 1.2 * len(theirs)


def test_extra_columns_with_clashing_names(spark, tmp_path):
    if os.path.exists(PATH):
        rows = docs(spark, ["ab c", None]).withColumns({"id": F.lit(3), "ids": F.lit(1)})
        assert [r.text for r in su.decoded(su.encode(rows, PATH), PATH).orderBy("id").collect()] == ["ab c", ""]


@pytest.mark.parametrize("unigram", [True, False])
def test_scores_of_a_unigram_file_are_used_whatever_they_are(tmp_path, unigram):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM if unigram else proto.TrainerSpec.BPE
    model.trainer_spec.byte_fallback = True
    kinds = proto.ModelProto.SentencePiece
    for piece, score, kind in [("<unk>", 0, kinds.UNKNOWN), *((f"<0x{b:02X}>", 0, kinds.BYTE) for b in range(256)), ("a", -1, kinds.NORMAL), ("b", -2, kinds.NORMAL), ("ab", -2, kinds.NORMAL), ("c", -7, kinds.NORMAL)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    got = su.load(str(tmp_path / "m.model")).scores[-4:].tolist()
    assert (got == [-1, -2, -2, -7]) == unigram

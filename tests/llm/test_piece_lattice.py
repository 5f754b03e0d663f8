import hashlib
import random
import struct

import pytest

from genoquill.llm import piece_lattice as P


def toy():
    pieces = ["<unk>", "<s>", *[f"<0x{i:02X}>" for i in range(256)], "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "▁▁"]
    kinds = [2, 2, *[1] * 256, *[0] * 11]
    scores = [0.0, 0.0, *[0.0] * 256, -5.0, -3.0, -3.0, -4.0, -4.0, -5.0, -6.0, -4.0, -6.0, -5.0, -9.0]
    return P.Codec(pieces, scores, kinds)


def every(codec, text):
    """All segmentations of a text by brute force."""
    marked = f" {text}" if text else ""

    def walk(at):
        if at == len(marked):
            yield 0.0, ()
            return
        single = marked[at] in codec.piece
        for end in range(at + 1, len(marked) + 1):
            found = codec.piece.get(marked[at:end])
            if found:
                for s, ids in walk(end):
                    yield s + found[1], (found[0], *ids)
        if not single:
            for s, ids in walk(at + 1):
                yield s + codec.unknown, (*codec.raw_ids(marked[at]), *ids)

    return sorted(walk(0), key=lambda x: -x[0])


def test_n_best_against_all_segmentations():
    codec, rng = toy(), random.Random(7)
    for _ in range(150):
        text = "".join(rng.choice("aabbc d") for _ in range(rng.randint(1, 9)))
        want = every(codec, text)
        for n in (1, 2, 5, 30):
            got = codec.encode(text, n)
            assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want[:n]]
            assert len({tuple(i) for _, i in got}) == len(got)
            assert all(codec.decode(ids) == text for _, ids in got)
            assert all((round(s, 9), tuple(ids)) in {(round(a, 9), b) for a, b in want} for s, ids in got)


@pytest.mark.parametrize("text", ["", " ", "  two  spaces ", "line\nbreak\ttab", "mark ▁ inside ▁▁", "日本語 \U0001f600 x", "a" * 50_000, "\x00\x7f", "▁", "word"])
def test_round_trip_with_the_model(text):
    codec = P.Codec(*P.load_vocabulary())
    for _, ids in codec.encode(text, 3):
        assert codec.decode(ids) == text


def test_the_library_decodes_what_is_encoded():
    import sentencepiece

    codec = P.Codec(*P.load_vocabulary())
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    ids = codec.encode("The quick brown fox jumps over the lazy dog", 1)[0][1]
    assert sp.decode(ids) == "The quick brown fox jumps over the lazy dog"


def slow_best(codec, text):
    """Score and ids of the best segmentation by plain dynamic programming; of equal scores the longest last piece."""
    text, out = f" {text}", [(0.0, ())]
    for end in range(1, len(text) + 1):
        found = [(out[start][0] + codec.piece[text[start:end]][1], -start, (*out[start][1], codec.piece[text[start:end]][0])) for start in range(max(0, end - codec.longest), end) if text[start:end] in codec.piece]
        if text[end - 1] not in codec.piece:
            found.append((out[end - 1][0] + codec.unknown, 1 - end, (*out[end - 1][1], *codec.raw_ids(text[end - 1]))))
        score, _, ids = max(found)
        out.append((score, ids))
    return out[-1]


@pytest.mark.parametrize("length", [1, 5, 40, 62, 63, 64, 65, 66, 130])
def test_one_tie_rule_at_every_length(length):
    codec, rng = toy(), random.Random(length)
    for _ in range(60):
        text = "".join(rng.choice("abc") for _ in range(length))
        score, ids = slow_best(codec, text)
        for n in (1, 4):
            got = codec.encode(text, n)
            assert (round(got[0][0], 9), tuple(got[0][1])) == (round(score, 9), ids)
            assert len({tuple(i) for _, i in got}) == len(got)
            assert len(got) == n or length < 40


def test_parts_together_are_as_one_by_one():
    codec, rng = P.Codec(*P.load_vocabulary()), random.Random(3)
    letters = "aaabcdeehilnorstu  ..,'éßñ日\n1\U0001f600▁"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["x" * 500, "", "ab" * 40]
    together = codec.encode_many(texts, 3)
    for text, got in zip(texts, together):
        assert [(s, i.tolist()) for s, i in got] == codec.encode(text, 3)
        if text:
            assert (got[0][0], tuple(got[0][1].tolist())) == slow_best(codec, text)


def test_blocks_change_nothing(monkeypatch):
    codec, rng = P.Codec(*P.load_vocabulary()), random.Random(5)
    texts = ["".join(rng.choice("abcde fgh  ") for _ in range(900)) for _ in range(5)]
    want = [[(s, i.tolist()) for s, i in x] for x in codec.encode_many(texts, 4)]
    monkeypatch.setattr(P, "BLOCK", 50)
    assert [[(s, i.tolist()) for s, i in x] for x in codec.encode_many(texts, 4)] == want


def test_frame(spark):
    rows = [(1, "hello world", 5), (None, None, 6), (3, "", 7), (3, "x y" * 4000, 8), (1, "hello world", 5)]
    got = P.encode_rows(spark.createDataFrame(rows, "doc_id long, text string, score int"), n=4)
    assert got.columns == ["doc_id", "ids", "score", "scores", "lossless", "decoded_sha256", "ids_sha256", "ids_sha256s"]
    out = got.collect()
    assert len(out) == 5 and all(r.lossless for r in out)
    assert [len(r.ids) for r in out if r.doc_id is None] == [0]
    assert all(r.ids_sha256s[0] == r.ids_sha256 and len(r.ids_sha256s) == len(r.scores) for r in out)
    for r in P.encode_rows(spark.createDataFrame(rows, "doc_id long, text string, score int"), n=4, every=True).collect():
        assert r.all_ids[0] == r.ids and [hashlib.sha256(struct.pack(f"<{len(x)}i", *x)).hexdigest() for x in r.all_ids] == r.ids_sha256s
    back = P.decode_documents(got)
    assert sorted(r.text for r in back.collect()) == sorted((t or "") for _, t, _ in rows)
    assert P.encode_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0

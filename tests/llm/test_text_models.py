"""SentencePiece matching, byte-level ids and packing, quality scores."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weftgraph.llm import packing, pieces, quality
from weftgraph.llm.lexicon import Lexicon
from weftgraph.llm.queries import byte_vocabulary
from weftgraph.llm.tokens import Ids

ODD = ["", " ", "a\xa0  b", "don't stop  'll x\n\n y", "x \t\n z ", "日本 é12abc's", "</s> <|endoftext|> hi", "a  b", "it’s — ok", "×a÷b", "end ", "▁▁x ▁", "\0\0 x", "a\0b", " " * 40, "aaaa" * 30]


def fuzz(n=3000):
    rng = random.Random(1)
    parts = [*"ab cD é'. ,\n\t12sтl日 ’×\x1f▁th e in\0😀", "the", "ing ", "'s", "'ll", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_pieces_equal_the_library():
    path = P.path("piece_bpe_32k.model")
    own, lib = pieces.Pieces(path, index_chars=500), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + fuzz()
    ids, ends = own.encode(texts)
    want = lib.encode(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    assert own.decode(ids, ends) == lib.decode(want)


def test_long_words_equal_the_library():
    path, rng = P.path("piece_bpe_32k.model"), random.Random(2)
    own, lib = pieces.Pieces(path, index_chars=700), sentencepiece.SentencePieceProcessor(model_file=path)
    word = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    texts = [" ".join([word(n), word(3), "ab" * n, "é漢😀the" * (n // 6)]) for n in (62, 63, 64, 65, 66, 300, 3000)]
    ids, ends = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == lib.encode(texts)


def test_a_word_of_a_million_letters():
    own, rng, took = pieces.Pieces(P.path("piece_bpe_32k.model")), random.Random(3), []
    for n in (125_000, 1_000_000):
        text, begin = "".join(rng.choices("etaoinshrdlucm", k=n)), time.process_time()
        ids, _ = own.encode([text])
        took.append(time.process_time() - begin)
        assert "".join(own.decode(ids, np.array([len(ids)]))) == text
    assert took[1] < 25 * took[0]  # a quadratic cost would be 64 times as high


def test_byte_ids_equal_the_library():
    v = byte_vocabulary()
    own, lib = Ids(v.tokenizer_path, v.ranks_path, v.pattern), Tokenizer.from_file(v.tokenizer_path)
    texts = [*ODD, "x<|endoftext|>y", "<|endoftext|>"] + fuzz()
    assert lib.encode("x<|endoftext|>y", add_special_tokens=False).ids == [87, 50256, 88]
    ids, ends = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_lexicon_survives_equal_hashes(monkeypatch):
    import weftgraph.llm.lexicon as lexicon

    monkeypatch.setattr(lexicon, "_BYTE", np.ones(256, np.uint64))
    own = Lexicon(lambda words: (np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])), np.uint8)
    data = np.frombuffer(b"abcdbaab", np.uint8)
    values, ends = own.values_of(data, np.array([0, 2, 4, 6]))
    assert values.tolist() == data.tolist() and ends.tolist() == [2, 4, 6, 8]


def test_sentencepiece_frames(spark):
    docs = spark.createDataFrame([(1, "Hello  world"), (2, None), (None, "</s> x"), (1, "Hello  world")], "doc_id long, text string")
    model = P.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(docs, model), model).collect()
    assert sorted((str(r.doc_id), r.text, len(r.ids)) for r in back) == [("1", "Hello  world", 3), ("1", "Hello  world", 3), ("2", "", 0), ("None", "</s> x", 4)]
    assert pieces.encode(docs.limit(0), model).count() == 0
    assert sorted(map(str, pieces.round_trip(docs, model).collect())) == sorted(map(str, back))
    assert pieces.round_trip(docs.limit(0), model).count() == 0


def test_packing(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["one", "two", "Zürich", "x1", "\n"]) for _ in range(rng.choice([0, 3, 40, 900]))) for i in range(60)}
    docs = spark.createDataFrame([*texts.items(), (99, None)], "doc_id long, text string").repartition(5)
    rows = packing.pack(docs, byte_vocabulary(), window=64).collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {*texts, 99}
    for doc, own in by_doc.items():
        ids = np.array(lib.encode(texts.get(doc, ""), add_special_tokens=False).ids + [1], "<u4")
        own.sort(key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes() and all(r.doc_tokens == len(ids) for r in own)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
    assert sorted(by_seq) == list(range(len(by_seq)))
    for seq, own in by_seq.items():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == 64 or seq == max(by_seq)
    assert packing.pack(docs.limit(0), byte_vocabulary()).count() == 0


def test_additive_model_with_a_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = (2 * np.sign(x[:, 0] * x[:, 1]) + x[:, 2] > 0).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_quality_frames(spark):
    good = "The first sentence is plain. Another one follows, as it should.\nThen a new line begins here."
    docs = spark.createDataFrame([(i, good + f" Number {i}." if i % 2 else "BUY!! NOW!! " * 20, "x") for i in range(120)] + [(500, None, "y"), (501, "", "z")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 122 and all(0 <= r.quality_score <= 1 for r in rows)
    assert all((r.quality_score >= 0.5) == bool(r.doc_id % 2) for r in rows if r.doc_id < 120)
    assert docs.columns + ["quality_score"] == quality.score(docs, model).columns
    none = quality.train(docs, labels.limit(0))
    assert {r.quality_score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_labels_of_the_held_out_third_are_not_used(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(300)], "doc_id long, text string")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = spark.createDataFrame([(i, 1) for i in held], "doc_id long, quality int")
    assert quality.train(docs, labels).base == 0.0


@pytest.mark.parametrize("text", ["", "a", "\n\n", "é" * 3, "word " * 50_000])
def test_features_are_finite(text):
    assert np.isfinite(quality.features(text)).all() and len(quality.features(text)) == len(quality.NAMES)

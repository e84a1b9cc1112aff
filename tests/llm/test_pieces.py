"""SentencePiece encoding and decoding against the library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from shroud.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "ing", " of", " " * 15, " " * 17, " " * 40, "é", "É", "1", "12", "²", "中", "文字", "▁", "▁▁", "<s>", "</s>", "<0x41>", "\U0001F600", "\x00", "\x85",
         "x", "xx", "ab" * 5, "natural", "before", "İ", "ß", "\u3000", "aaaaaaa", "====", "\r\n"]
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    r = random.Random(4)
    out = ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(1500)]
    for letters in ("etaoinshr", "ab", "▁ abé中", "=-", "0123456789 "):
        out += ["".join(r.choice(letters) for _ in range(r.randrange(300))) for _ in range(150)]
    return [*out, "", " ", "▁", "ab" * 2000, " " * 900, "x" * 5000, " \n" * 500, "".join(r.choice("etaoinshrdlu") for _ in range(30_000))]


def test_encoder_equals_the_library():
    some = texts()
    want = LIBRARY.encode(some)
    assert [x.tolist() for x in pieces._encoder(PATH).encode([pieces.marked(t) for t in some])] == want
    model = pieces._model(PATH)
    assert [model.decode(np.array(w, np.int64)) for w in want] == [LIBRARY.decode(w) for w in want]


def test_rounds_without_cuts_equal_the_library():
    """The merge rounds alone, on whole texts as single words."""
    some = [t for t in texts() if 0 < len(t) < 400][:400]
    assert pieces._model(PATH).encode_words([pieces.marked(t) for t in some]) == LIBRARY.encode(some)


def test_decodes_any_ids():
    r, model = random.Random(6), pieces._model(PATH)
    pool = [0, 1, 2, *range(3, 259), *range(259, 300), 28705, 29871]
    for _ in range(3000):
        ids = [r.choice(pool) for _ in range(r.randrange(12))]
        assert model.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids), ids


def test_round_trip(docs, nothing):
    got = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert set(got.columns) == {*docs.columns, "decoded"} and got.count() == docs.count()
    for r in got.collect():
        want = LIBRARY.encode(r.text or "", add_eos=True)
        assert r.ids == want and r.decoded == LIBRARY.decode(want)
    assert all(len(r.ids) == 0 for r in pieces.encode(docs.where("text IS NULL"), PATH, end=False).collect())
    assert pieces.encode(nothing, PATH).count() == 0
    assert pieces.decode(docs.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), PATH).where("decoded <> ''").count() == 0


def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in queries.QUERIES["op11_sentencepiece_round_trip"](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)))

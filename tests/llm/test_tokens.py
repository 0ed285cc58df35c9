import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import odd_documents
from vexel.llm import bpe, wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
HARD = ["  a  b\n\n c'll ²³ x½ \x1c\x1d <|endoftext|> 日本語 12३४ ñ", "<|endoftext|>", "á ​    x", "aaaaaaaaaaaaa bbbb", " lead", "trail ", "\n", "x\ny", "😀😀 it's we'll", "<|endoftext|><|endoftext|>a"]


def ids_of(texts):
    return [e.ids for e in TOKENIZER.encode_batch(list(texts), add_special_tokens=False)]


def digest(ids, text):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


#: Beyond a buffer of the encoder and a shard of the files.
LONG = ["".join(f"word{i % 977} and line {i}\n" for i in range(500_000)), "x" * 3_000_000, "short"]


@pytest.mark.parametrize("kind", ["whole", "odd", "hard", "empty", "long"])
def test_encoding_and_files(spark, sf, kind):
    docs = {"whole": lambda: spark.read.parquet(f"{sf}/documents.parquet"), "odd": lambda: odd_documents(spark), "empty": lambda: odd_documents(spark, True), "hard": lambda: spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string"), "long": lambda: spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")}[kind]()
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    ids = ids_of(t for _, t in rows)
    want = sorted(((d, *digest(i, TOKENIZER.decode(i, skip_special_tokens=False))) for (d, _), i in zip(rows, ids)), key=str)
    assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str) == want
    got = sorted(((r.doc_id, *digest(r.ids, r.decoded)) for r in bpe.encoded(docs, PATH).collect()), key=str)
    assert got == want
    ordered = sorted(zip(rows, ids), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1].encode()))
    start, out = 0, []
    for (d, _), i in ordered:
        out.append((d, start, len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())))
        start += len(i) + 1
    assert sorted(map(tuple, wavelet.stored_ids(docs, PATH).collect()), key=str) == sorted(out, key=str)


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (7, 3), (1000, 40), (5000, 50_000), (1024, 2)):
        ids = rng.integers(0, top, n)
        m = wavelet.WaveletMatrix.of(ids)
        m = wavelet.WaveletMatrix(m.n, [p.tobytes() for p in m.planes], [o.astype("<u4").tobytes() for o in m.ones], m.zeros)
        assert m.ids().tolist() == ids.tolist()
        for i in rng.integers(0, max(n, 1), 20 if n else 0).tolist():
            t = int(ids[i])
            assert m.access(i) == t and m.rank(t, i) == int((ids[:i] == t).sum())
            assert m.select(t, m.rank(t, i)) == i
        if n:
            assert m.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist()
        assert m.rank(10**6) == 0


def test_find(spark):
    docs = spark.createDataFrame([(i, "the cat saw the dog") for i in range(20)], "doc_id long, text string")
    from vexel.llm import common

    path = common.shared_dir(spark)
    wavelet.write(docs, path, PATH)
    ids = [t for i in ids_of(["the cat saw the dog"] * 20) for t in [*i, 0]]
    token = ids[1]
    assert sorted(r.start + r.place for r in wavelet.find(wavelet.read(spark, path), token).collect()) == [i for i, t in enumerate(ids) if t == token]


def test_forgotten_pieces(monkeypatch):
    """Encoders that keep few pieces give the library's ids before and after they forget some."""
    monkeypatch.setattr(bpe, "CACHE", 40)
    rng = np.random.default_rng(1)
    words = ["the", "of", "naïve", "ÿ", "12", "it's", "日本", "\n", " ", "<|endoftext|>"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(200)]
    want = ids_of(texts)
    wavelet._encoders.pop(PATH, None)
    for encoder in (wavelet.library_encoder(PATH), bpe.Encoder(*(lambda v: (v.special, v.split, lambda ws: v.encode([w.encode() for w in ws])))(bpe.Vocabulary(PATH)))):
        got = []
        for i in range(0, len(texts), 7):
            ids, lens = encoder.texts(texts[i : i + 7])
            got += [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]
        assert got == want
        assert len(encoder.uses) == len(encoder.pieces) == len(encoder.piece_lens)
    wavelet._encoders.pop(PATH, None)

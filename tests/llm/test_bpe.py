import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "aaaaaaaaaa aaaaaaaaaaaaa", "日本語 text <|endoftext|> x<|endoftext|>", "  \n\n \t x  ", "\x1c\x1d a b ²³ 12¼", "ǅ ª º", "don't we'll I'D   x", "é ́", "''s's 's", "\0"]


def encoded(texts):
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    ((ids, counts),) = list(e.encode([texts]))
    return np.split(ids, np.cumsum(counts)[:-1]), e.decode(ids, counts)


def test_like_the_library():
    rng = random.Random(5)
    letters = "aab bs st 's 've 'r 'll' d m  \n\t' ' .,;1234²¼ é\xa0\x85\x1c Ż　 日"
    texts = ODD + ["".join(rng.choice(letters[: rng.choice([20, 60, 80])]) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    ids, back = encoded(texts)
    wanted = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in ids] == [w.ids for w in wanted] and back == texts


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_with_equal_hashes(monkeypatch):
    word = thue_morse(2048)
    texts = [word, word.translate({97: 98, 98: 97}), "q" * 5000, "q" * 4999 + "p", "’’ “x” 日本語 héllo 🙂 " * 3, *ODD]
    wanted = [w.ids for w in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    ids, back = encoded(texts)
    assert [x.tolist() for x in ids] == wanted and back == texts
    real = bpe.Stretches.hashes
    monkeypatch.setattr(bpe.Stretches, "hashes", lambda *a: real(*a) & np.uint64(3))  # nearly all words collide
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    for _ in range(2):
        ((flat, counts),) = list(e.encode([texts]))
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == wanted


def test_broken_bytes_decode_like_the_library():
    t = Tokenizer.from_file(PATH)
    ids = t.encode("日本", add_special_tokens=False).ids[:-1]
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    assert e.decode(np.array(ids), np.array([len(ids)]))[0] == t.decode(ids, skip_special_tokens=False)


def test_frame(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (4, "ab " * 20000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_decode(df, PATH).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("h"), "decoded", "text").collect()
    t = Tokenizer.from_file(PATH)
    for r in got:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["decoded"] == (r["text"] or "")
        assert r["h"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert len(got) == 5 and bpe.encode_decode(df.limit(0), PATH).count() == 0

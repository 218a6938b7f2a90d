import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from weftgraph.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "\n\n  x", "it's we'll I'M", "a" * 5000, "ab" * 3000 + "é" * 500, "tab\tnl\r\n\x1c\x1d\x85\xa0 end", "½ ² ٣ 漢字 かな 😀👩‍👩‍👧", "<|endoftext|> x", "\x00\x01 ~~!!", "naïve Straße ñandú  çà", "１２ ⅷ ​ ﻿", "'s 't 're", "  ", "ॐ क्षि", "x' 'd", "ɏ ɐ Ƶ"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    words = ["thing", "ciónra", "überzeit", "éaux", "AKIA", "0x1f", "don't", "!?", "\n", " ", "zzzzqqq"]
    return ODD + ["".join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(rng.randrange(60))) for _ in range(60)] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x4E00, 0x4F00)])) for _ in range(80)) for _ in range(60)]


def test_matches_tiktoken_and_round_trips(spark):
    ref = reference()
    rows = [(i, t, "ids", 1) for i, t in enumerate(texts())] + [(None, "a b", "", 2), (1, "", "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = byte_bpe.encode(docs, PATH, P.PATTERN)
    want = sorted(((i, ref.encode_ordinary(t or "")) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == want
    back = sorted(((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(got, PATH).collect()), key=str)
    assert back == sorted(((i, (t or "").encode()) for i, t, *_ in rows), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = sorted((tuple(r) for r in byte_bpe.digests(docs, PATH, P.PATTERN).collect()), key=str)
    assert digests == sorted(((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for (i, t, *_), ids in ((r, ref.encode_ordinary(r[1] or "")) for r in rows)), key=str)


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 3, 10, 1000):
        keys = [f"k{i}".encode() for i in range(n)]
        h = byte_bpe.PerfectHash(keys)
        assert sorted(h.slot(k) for k in keys) == list(range(n))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"])


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 10)
    t = byte_bpe.Tokenizer(byte_bpe.read_ranks(PATH), P.PATTERN)
    ref = reference()
    text = " ".join(f"word{i}" for i in range(200)) + " " + "q" * 100
    assert t.encode(text).tolist() == ref.encode_ordinary(text) and len(t) <= 10


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0

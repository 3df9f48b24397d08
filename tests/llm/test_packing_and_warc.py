import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinal.llm import packing, warc
from vicinal.llm.runtime import default_tokenizer
from vicinal.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def test_encoder_equals_tokenizer(tokenizer):
    rng = random.Random(5)
    letters = list("ab'sx1.,é \r\n\t  ") + [" ", " ", "don't", "\x1c", "漢字", "🙂"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, "", "word " * 5000]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b\n<|endoftext|>", "<|endoftext", "x" * 300 + " y"]
    tool = Encoder(default_tokenizer())
    got = [ids[b[i] : b[i + 1]].tolist() for s, e, ids, b in tool.encode_column(pa.array(texts)) for i in range(e - s)]
    assert got == [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    tool.fast = None  # by the tokenizer itself
    tool._forget()
    again = [ids[b[i] : b[i + 1]].tolist() for s, e, ids, b in tool.encode_column(pa.array(texts[-900:])) for i in range(e - s)]
    assert again == got[-900:]


def test_units_of_equal_hashes_are_told_apart(tokenizer, monkeypatch):
    from vicinal.llm import tokens

    monkeypatch.setattr(tokens, "span_hashes", lambda buf, s, e: (e - s).astype(np.uint64))  # units of one length collide
    texts = ["one two six ten", "red cat dog", "aaaa bbbb cccc aaaa", "one two six ten"]
    tool = Encoder(default_tokenizer())
    got = [ids[b[i] : b[i + 1]].tolist() for s, e, ids, b in tool.encode_column(pa.array(texts)) for i in range(e - s)]
    assert got == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_tile_every_document(spark, tokenizer):
    rng = random.Random(6)
    texts = [" ".join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(0, 700))) for _ in range(150)] + [None, "", "long text " * 20000]
    df = spark.createDataFrame([(i // 2 * 2 if i < 4 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit(0)).coalesce(2)
    rows = packing.pack(df, default_tokenizer()).collect()
    want = sorted((i // 2 * 2 if i < 4 else i, np.array([*x.ids, 0], "<u4").tobytes()) for i, x in enumerate(tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)))
    runs, open_docs = [], {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.doc_tokens, r.start, r.sequence_id)):
        open_docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (i, n), pieces in open_docs.items():
        assert sum(p.length for p in pieces) == n
        runs.append((i, b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start))))
    assert sorted(runs) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length * 4 == len(r.ids) and zlib.crc32(bytes(r.ids)) >= 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) / (1024 * len(seqs)) > 0.97
    assert packing.pack(df.limit(0), default_tokenizer()).count() == 0


def test_differencing_levels_windows():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 200)
    dealt = packing.differencing(sizes, 40)
    assert sorted(i for w in dealt for i in w) == list(range(200))
    loads = [sizes[w].sum() for w in dealt]
    assert max(loads) - min(loads) < 40
    assert all(sizes[w].sum() <= 500 for w in packing.level(sizes, 500))
    assert packing.level(np.array([1024]), 1024) == [[0]] and packing.differencing(np.array([], int), 1) == [[]]


def test_archives_round_trip(spark, tmp_path):
    trap = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>"
    pages = [(3, "http://a/x y\n", "<p>hi</p>"), (1, "http://b", "<p>hi</p>"), (2, None, None), (5, "u", ""), (7, "u", trap), (8, "u", trap), (9, "v", "ü" * 100000), (1, "http://b", "<p>hi</p>"), (None, "n", "<p>hi</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(2)
    warc.write_archives(df, str(tmp_path / "w"), classes=((1000, 3), (None, 1)), compressed=False)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = i != first[h or ""]
        want.append((i, "revisit" if again else "response", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), first[h or ""] if again else None, None if again else h or ""))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.payload) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chain_ignores_heads_inside_payloads():
    record = lambda body: b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    data = record(b"one") + record(record(b"inner") + b" tail") + record(b"")
    found = list(warc.candidates(data))
    seen = warc.reachable(np.array([f[0] for f in found]), np.array([f[1] for f in found]), len(data))
    assert len(found) == 4 and [bytes(f[3]) for f, s in zip(found, seen, strict=True) if s][::2] == [b"one", b""]
    with pytest.raises(ValueError):
        warc.reachable(np.array([0]), np.array([5]), 9)


def test_damaged_archives_are_errors(spark, tmp_path):
    def read(name, data):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        return warc.read_archives(spark, str(tmp_path / name)).collect()

    def record(payload, digest):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a\r\n /b\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (digest, len(block), block)

    good = base64.b32encode(hashlib.sha1(b"hello").digest())
    (row,) = read("good", record(b"hello", good))
    assert row.payload == "hello" and row.url == "http://a /b"  # a folded line
    with pytest.raises(Exception, match="lacks its digest"):
        read("changed", record(b"hallo", good))
    with pytest.raises(Exception, match="breaks before its end"):
        read("garbage", b"no archive at all")
    with pytest.raises(Exception, match="breaks before its end"):
        read("cut", record(b"hello", good) + record(b"hello", good)[:-9])
    with pytest.raises(Exception, match="EOFError|end-of-stream"):
        read("gzip", gzip.compress(record(b"hello", good) * 99)[:-20])
    assert read("empty", b"") == []
    trapped = record(b"x" + record(b"hallo", good), base64.b32encode(hashlib.sha1(b"x" + record(b"hallo", good)).digest()))
    assert len(read("trap", trapped)) == 1  # a damaged record inside a payload is none

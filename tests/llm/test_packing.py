from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from offerscope.llm import packing
from offerscope.llm.packing import Limits, encoder, pack, pack_documents, token_bytes

PATH = P.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)


def ids(text):
    return REAL.encode(text or "", add_special_tokens=False).ids + [1]


def test_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    letters = [*"ab1 '\n\t\r.,é 　 \x85\x1c\x1f​🙂ſKs!", "'s", "'re", " a", "<|endoftext|>", "  ", " \n "]
    for _ in range(3000):
        text = "".join(rng.choices(letters if rng.random() < 0.5 else [*"abé1 \n,!", "'s", " a", "\x1c"], k=rng.randint(0, 14)))
        assert np.frombuffer(token_bytes(PATH, text), "<u4").tolist() == REAL.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_code_point_gives_the_ids_of_the_library():
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000, 1)] if c < 0x32000 or c % 61 == 0 or 0xE0000 <= c < 0xE0200]
    texts = ["".join(f"a{c}b {c} {c}{c}1" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    for text, real in zip(texts, REAL.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(token_bytes(PATH, text), "<u4").tolist() == real.ids


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_texts_of_a_slice_give_the_ids_of_each(kind):
    rng = random.Random(2)
    plain = ["a", "b'", "é", "1", "🙂", "'s", "ſK", ",", "\x1c", "​", "the", " ", " ", "\n"]
    odd = [*plain, "  ", "\n\n", " \n", "\t", "\0", "\u3000", "\x85", "<|endoftext|>"]
    for _ in range(200):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(rng.choice([plain, odd]), k=rng.randint(0, 9))) for _ in range(rng.randint(1, 30))]
        lo = rng.randrange(len(texts))
        own = encoder(PATH)(pa.array(texts, kind)[lo:])
        assert [x.tolist() for x in own] == [REAL.encode(t or "", add_special_tokens=False).ids for t in texts[lo:]], texts[lo:]
    assert encoder(PATH)(pa.array([], kind)) == []


def test_a_task_encodes_a_bounded_slice_at_a_time(monkeypatch):
    sizes = []

    def encode(texts):
        sizes.append(sum(map(len, texts.to_pylist())))
        return [np.full(len(t), 7, "<u4") for t in texts.to_pylist()]

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = classmethod(lambda cls: 0)  # noqa: N815

    monkeypatch.setattr(packing, "encoder", lambda path: encode)
    monkeypatch.setattr(packing, "TaskContext", Task)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "text": ["ten chars " * 1000] * 500})
    out = pa.Table.from_batches(packing._packer(PATH, 1, Limits())(iter([batch])))
    assert max(sizes) <= 1 << 20 and sum(sizes) == 5_000_000
    assert sum(out.column("length").to_pylist()) == 500 * 10_001


def test_different_words_of_a_slice_are_encoded_in_one_call(monkeypatch):
    given = []
    for name in ("encode_ordinary", "encode_to_numpy"):
        real = getattr(tiktoken.Encoding, name)
        monkeypatch.setattr(tiktoken.Encoding, name, lambda self, text, *a, real=real, **k: given.append(len(text)) or real(self, text, *a, **k))
    monkeypatch.setattr(packing, "_KNOWN", {})
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    words = [f"w{i}x" for i in range(20_000)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)] * 4
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    rows = pa.Table.from_batches(packing._packer(PATH, 1, Limits())(iter([batch]))).to_pylist()
    assert len(given) == 1 and sum(given) <= sum(len(w) + 1 for w in words) + len(texts) * 8
    for doc, text in enumerate(texts[:40]):
        own = np.array(ids(text), "<u4")
        for r in rows:
            if r["doc_id"] == doc:
                assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(own)


@pytest.mark.parametrize("run", [" ", "\n", "x", "-"])
def test_runs_of_over_a_million_characters(run):
    text = "a" + run * 1_100_000 + "b"
    assert np.frombuffer(token_bytes(PATH, text), "<u4").tolist() == REAL.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library_with_whole_texts(tmp_path):
    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "other.json"))
    texts = ["b c\nd", None, "", " e  f"]
    own = encoder(str(tmp_path / "other.json"))(pa.array(texts))
    assert [x.tolist() for x in own] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_the_limits_of_documents_bind(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seqs = defaultdict(list)
    for r in pack_documents(docs, PATH, 1).collect():
        seqs[r.sequence_id].append(r)
    limits = Limits()
    size, loss = [sum(r.length for r in s) for s in seqs.values()], [sum(r.loss_tokens for r in s) for s in seqs.values()]
    assert max(loss) == limits.loss and sum(x == limits.loss for x in loss) > len(seqs) / 4
    assert max(map(len, seqs.values())) <= limits.segments and sum(size) > 0.97 * 2048 * len(seqs)


@pytest.mark.parametrize("limits", [Limits(), Limits(tokens=64, segments=3, loss=60), Limits(tokens=2048, segments=512, loss=2048, buffer=5, waiting=2)])
def test_every_id_lies_in_one_piece(edge, edge_rows, empty, limits):
    small = limits
    rows = pack_documents(edge, PATH, 1, small).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    text = defaultdict(list)
    for r in edge_rows:
        text[r[0]].append(r[1])
    for doc, texts in text.items():
        left = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[doc])
        expected = []
        for t in texts:
            own = np.array(ids(t), "<u4")
            # pieces of repeated rows are alike only as far as their cuts are; each start belongs to some piece
            expected.append(own)
        assert sum(x[1] for x in left) == sum(map(len, expected))
        for start, length, crc, n in left:
            assert any(len(o) == n and zlib.crc32(o[start : start + length].tobytes()) == crc for o in expected)
        if len(texts) == 1:
            at = 0
            for start, length, *_ in left:
                assert start == at
                at += length
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= small.tokens and len(own) <= small.segments and sum(r.loss_tokens for r in own) <= small.loss
    if small == Limits():
        used = sum(r.length for r in rows)
        assert len(seqs) <= used / small.loss + len(rows) / small.segments + 2 * 3 + 1
    assert pack_documents(empty, PATH, 1, small).count() == 0


def test_examples_are_packed_whole_under_all_limits():
    rng = random.Random(5)
    limits = Limits(tokens=1000, segments=8, loss=300)
    pieces = [(n, rng.randint(0, min(n, 300)), k, 0) for k, n in enumerate(rng.choices(range(5, 700), k=3000))]
    out = list(pack(iter(pieces), limits, None))
    assert sorted(p for s in out for p, _ in s) == sorted(pieces)
    for s in out:
        assert sum(p[0] for p, _ in s) <= 1000 and len(s) <= 8 and sum(p[1] for p, _ in s) <= 300
    need = max(sum(p[0] for p in pieces) / 1000, sum(p[1] for p in pieces) / 300, len(pieces) / 8)
    assert len(out) < 1.15 * need

"""Vector bin packing of tokenised examples.

Sequences have three limits: tokens, segments and loss-bearing tokens. Each document is cut
into full sequences and a rest. Rests wait in a bounded buffer; a sequence is filled by taking,
of the waiting pieces that fit, the one whose demand vector (tokens, segments, loss tokens, each
over its limit) has the largest dot product with the sequence's remaining capacity. Where no
piece fits whole, the largest one is cut to what is left, so only segment or loss limits and a
task's last sequence leave padding. Instruction examples are packed without cuts.

The limits of documents bind: a sequence bears at most LOSS loss tokens, a little under its 2048 tokens, so
a long document's inner pieces have LOSS ids and a sequence is filled up only by beginnings, whose first id bears no loss; and it
has at most SEGMENTS segments, so the tiniest documents are spread over sequences.

Each task packs its own rows in one streaming pass: no shuffle, memory bounded by the
buffer, and the token ids never leave the task. Sequence numbers hold the partition number in
the upper bits, so they are unique and a task that is run again gives the same rows.

A document's ids are those of the tokenizer for its whole text, then an end id. Texts are cut
into words with the white space before them, which the tokenizer's own pre-tokenizer does too; the
different words of a slice of texts are encoded once each, and the ids of its texts are gathered
from these, without a Python object for each word. That holds for byte-level BPE files with the usual
pre-tokenizer; texts with other white space than single spaces and line ends between words are
encoded whole, and those that hold a special token's string go to the tokenizer itself.
All ids but a document's first bear loss, as nothing precedes that one.

Defined results: null or empty text is the end id alone; a null doc_id is kept; repeated rows
are packed each; very long texts are cut to as many pieces as they need; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.llm.words import buffers, lean, ranges
from tokenizers import Tokenizer

#: Loss-bearing tokens and segments of a sequence of documents.
LOSS, SEGMENTS = 2046, 12
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Texts are encoded in slices of about this many bytes; a slice's temporaries are many times as large.
SLICE_BYTES = 1 << 20
#: Fixed value: the usual pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts without this are cut before each space and line end: these stand alone, between other characters.
_UNCUT = r"[\x00\x09\x0B-\x0D\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = SEGMENTS
    loss: int = LOSS
    #: Pieces, and full sequences of tokens, that wait in a task.
    buffer: int = 4096
    waiting: int = 64


class Encoder:
    """Ids of texts.

    They are encoded with the merge ranks in the tokenizer's file where these are a plain byte-level BPE whose
    ids follow the order of merges (the same ids, in less time), else by the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None  # the tokenizer is loaded only if asked for
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        ranks = _merge_ranks(file)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        if ranks:
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            self.sizes[list(ranks.values())] = [len(b) for b in ranks]

    def whole(self, text: str) -> np.ndarray:
        """The tokenizer's own ids."""
        self.tokenizer = self.tokenizer or Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def one(self, text: str) -> np.ndarray:
        """Ids of any text."""
        if self.fast and not any(t in text for t in self.special):
            try:
                return self.fast.encode_to_numpy(text)
            except ValueError:  # its pattern gives up on runs of a million characters
                pass
        return self.whole(text)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.fast:
            return [self.whole(t) for t in texts.to_pylist()]
        cut = pc.invert(pc.match_substring_regex(texts, _UNCUT))
        for t in self.special:
            cut = pc.and_(cut, pc.invert(pc.match_substring(texts, t)))
        rest = iter(texts.filter(pc.invert(cut)).to_pylist())
        own = iter(self._by_words(texts.filter(cut)))
        return [next(own) if c else self.one(next(rest)) for c in cut.to_pylist()]

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts that can be cut before each space and line end.

        A line end, one id of its own, is put before each text, so that its first word is a chunk like all others. The
        different chunks, one after the other, are such a text again; where a chunk ends is known from the bytes of its ids.
        """
        if not len(texts):
            return []
        line, none = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        lists = pc.split_pattern(pc.binary_join_element_wise(line, marked, none), "\0")
        chunks = lists.flatten().dictionary_encode()
        stops = np.cumsum(pc.binary_length(chunks.dictionary).to_numpy(zero_copy_only=False))
        try:
            ids = self.fast.encode_to_numpy(str(memoryview(chunks.dictionary.buffers()[2])[: stops[-1]], "utf-8"))
        except ValueError:
            return [self.one(t) for t in texts.to_pylist()]
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), stops) + 1
        starts = np.append(0, ends[:-1])
        at = chunks.indices.to_numpy()
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        lengths, begin = (ends - starts)[at], starts[at]
        begin[first] += 1
        lengths[first] -= 1
        stop = np.cumsum(lengths)
        place = np.repeat(begin - stop + lengths, lengths)
        place += np.arange(len(place))
        return np.split(ids[place], (stop - lengths)[first[1:]])


def _merge_ranks(file: dict) -> dict[bytes, int] | None:
    """Rank by token bytes, or None where ids don't follow the merges or the steps aren't the usual ones."""
    before, model = file.get("pre_tokenizer") or {}, file["model"]
    if file.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or model.get("type") != "BPE":
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    try:
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        return {bytes(as_byte[c] for c in t): i for t, i in model["vocab"].items() if t not in {a["content"] for a in file["added_tokens"]}}
    except KeyError:
        return None


_KNOWN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _KNOWN:
        _KNOWN[path] = Encoder(path)
    return _KNOWN[path]


def token_bytes(path: str, text: str) -> bytes:
    """The tokenizer's ids of a text as little-endian unsigned 32-bit bytes."""
    return encoder(path)(pa.array([text], pa.large_string()))[0].tobytes()


def document_loss(start: int, tokens: int) -> int:
    """Loss-bearing ids of a document's piece: all but the document's first id."""
    return tokens - (start == 0)


def pack(pieces: Iterator[tuple], limits: Limits, loss_of: Callable[[int, int], int] | None = document_loss) -> Iterator[list[tuple]]:
    """Sequences, as lists of (piece, offset); a piece is (tokens, loss tokens, key, start).

    loss_of gives the loss tokens of a part (start, tokens) of a piece; None: pieces aren't cut.
    """
    waiting: list[tuple] = []

    def fill() -> list[tuple]:
        size, loss = np.array([p[0] for p in waiting]), np.array([p[1] for p in waiting])
        there = np.ones(len(waiting), bool)
        tokens, segments, bearing = limits.tokens, limits.segments, limits.loss  # what is left
        out, offset, rest = [], 0, None
        while tokens and segments:
            fits = (there & (size <= tokens) & (loss <= bearing)).nonzero()[0]
            if len(fits):
                gain = size[fits] * (tokens / limits.tokens**2) + segments / limits.segments**2 + loss[fits] * (bearing / limits.loss**2)
                at = int(fits[gain.argmax()])
                piece = waiting[at]
            elif loss_of and bearing and there.any():
                at = int(np.where(there, size, -1).argmax())
                whole, _, key, start = waiting[at]
                own = min(whole, tokens, bearing)
                piece = (own, loss_of(start, own), key, start)
                rest = (whole - own, loss_of(start + own, whole - own), key, start + own)
            else:
                break
            there[at] = False
            out.append((piece, offset))
            offset += piece[0]
            tokens, segments, bearing = tokens - piece[0], segments - 1, bearing - piece[1]
            if rest:  # a piece is cut only where nothing fits, so the sequence ends here
                break
        waiting[:] = [p for p, t in zip(waiting, there.tolist(), strict=True) if t] + ([rest] if rest else [])
        return out

    held = 0
    for piece in pieces:
        if piece[0] > limits.tokens or piece[1] > limits.loss:
            raise ValueError("a piece is over the limits")
        if piece[0] == limits.tokens or piece[1] == limits.loss and limits.tokens - limits.loss < 4:
            yield [(piece, 0)]  # full, or all but full
            continue
        waiting.append(piece)
        held += piece[0]
        while len(waiting) >= limits.buffer or held >= limits.tokens * limits.waiting:
            done = fill()
            held -= sum(p[0] for p, _ in done)
            yield done
    while waiting:
        yield fill()


def _packer(path: str, end_id: int, limits: Limits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, tuple] = {}  # key -> doc_id, ids, tokens that wait
        end = np.array([end_id], "<u4").tobytes()
        encode = encoder(path)
        key = 0
        ready: list[tuple] = []

        def pieces():
            nonlocal key
            for batch in batches:
                for lo, hi in ranges(buffers(batch.column(1))[1], SLICE_BYTES):
                    for doc, own in zip(batch.column(0)[lo:hi].to_pylist(), encode(batch.column(1)[lo:hi]), strict=True):
                        ids = own.tobytes() + end
                        n = len(ids) // 4
                        texts[key] = [doc, ids, n]
                        start = 0
                        while start < n:
                            size = min(limits.tokens, limits.loss + (start == 0), n - start)
                            yield size, document_loss(start, size), key, start
                            start += size
                        key += 1

        number = TaskContext.get().partitionId() << 36
        for sequence in pack(pieces(), limits):
            for (size, loss, k, start), offset in sequence:
                held = texts[k]
                ready.append((held[0], start, size, zlib.crc32(held[1][4 * start : 4 * (start + size)]), len(held[1]) // 4, number, offset, loss))
                held[2] -= size
                if not held[2]:
                    del texts[k]
            number += 1
            if len(ready) > 5000:
                yield _rows(ready)
                ready.clear()
        yield _rows(ready)

    return run


def _rows(ready: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], pa.int64()) for i in range(len(names))], names=names)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_packer(tokenizer, end_id, limits)), SCHEMA)

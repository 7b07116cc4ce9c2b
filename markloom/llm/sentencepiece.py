"""SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is parsed here; normaliser (character map, white-space rules, dummy prefix), metaspace
marker, piece scores and byte fallback are rebuilt as a ``tokenizers.Tokenizer``. A unigram model keeps its scores;
a BPE model's scores are the order of its merges. Whole normalised texts are encoded in batches, by as many threads as
the task has cores (spark.task.cpus), and the sentencepiece library encodes the raw texts beside it: ``parity`` tells
whether both give the same ids, so a fault of the character map, the white-space rules, the marker or the merges would
show."""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from markloom.llm.common import arrow_pass, steps

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, others as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """What the model file says: pieces as (text, score, kind), and the settings that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
                m.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                m.model_type, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                m.charsmap = f.get(2, b"")
                m.dummy_prefix, m.squeeze, m.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        if m.model_type not in (UNIGRAM, BPE):
            raise ValueError(f"model type {m.model_type} is neither unigram nor BPE")
        return m

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join to a piece, by the joined piece's score, as BPE applies them."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                if left in ids and right in ids:
                    found.append((-self.pieces[i][1], ids[left], ids[right], left, right))
        found.sort()
        return [(left, right) for *_, left, right in found]


class Encoder:
    """Rebuilt tokenizer of a model file, with the sentencepiece library beside it for parity."""

    def __init__(self, data: bytes):
        import sentencepiece
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

        self.model = m = PieceModel.parse(data)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        unk = m.pieces[m.unk_id][0]
        if m.model_type == UNIGRAM:
            vocab = [(p, s) for p, s, _ in m.pieces]
            backend = models.Unigram(vocab, unk_id=m.unk_id, byte_fallback=m.byte_fallback)
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
            backend = models.BPE(vocab, m.merges(), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(backend)
        if user := [p for p, _, kind in m.pieces if kind == USER]:
            self.tokenizer.add_tokens([AddedToken(p, normalized=True, special=False) for p in user])
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
        self.normalizer = normalizers.Sequence(steps) if steps else None
        self.raw = [self._bytes(*p) for p in m.pieces]

    def _bytes(self, piece: str, _score: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        """The text as it is encoded: white space marked, one marker put before it."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def encode_batch(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """(ids, parity) of each text."""
        ours = [e.ids for e in self.tokenizer.encode_batch_fast([self.normalise(t) for t in texts], add_special_tokens=False)]
        theirs = self.reference.encode(texts, num_threads=1)
        return [(own, own == other) for own, other in zip(ours, theirs, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: byte pieces joined as UTF-8, markers as spaces, the dummy prefix taken away."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _encoder(data: bytes, kept: dict = {}) -> Encoder:  # noqa: B006  one per Python worker
    key = hash(data)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(data)
    return kept[key]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str = MODEL_PATH, chars_per_step: int = 500_000) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip, parity for every row of ``docs`` (doc_id, text).

    ``round_trip`` tells whether decoding the ids gives the whole text again, ``parity`` whether the
    sentencepiece library gives the same ids for the raw text. Null and empty texts have no ids and both flags true.
    Very long texts are encoded whole. A text holding the marker character itself reads back with a space in its
    place and has round_trip false. Repeated rows are encoded each. Other columns are not used. Empty table: no
    rows. The model file is read on the driver (``model_path``) and its bytes, of fixed size, are sent to the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(TaskContext.get().cpus()))  # threads of a batch: the task's own cores
        encoder = _encoder(sent.value)
        for batch in batches:
            ids, ends, same, back = array("i"), [0], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in steps(texts, chars_per_step):
                for text, (own, ok) in zip(part, encoder.encode_batch(part), strict=True):
                    ids.extend(own)
                    ends.append(len(ids))
                    same.append(ok)
                    back.append(encoder.decode(own) == text)
            ends = np.array(ends, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(back, pa.bool_()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids", "round_trip", "parity"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(docs.select("doc_id", "text"), apply, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, text for every row of ``encoded`` (doc_id, ids). Null or empty ids give an empty text; ids outside
    the vocabulary raise an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return arrow_pass(encoded.select("doc_id", "ids"), apply, f"doc_id {kind}, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

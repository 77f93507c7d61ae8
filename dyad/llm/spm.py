"""SentencePiece encoding and decoding with the ``tokenizers`` library.

The model file is parsed from its protobuf wire format.  A tokenizer is rebuilt
from it: the normaliser (compiled character map, extra spaces, dummy prefix,
spaces to the metaspace marker), the pieces with their unigram scores, or for
a BPE model the merges that the piece order implies, and byte fallback.

Where no piece has a marker behind another character (checked on the model) no
merge crosses the start of a word, so a text's ids are those of its chunks
between single spaces: distinct chunks are encoded once, texts with runs of
spaces whole.  Every distinct chunk and whole text is encoded by the
``sentencepiece`` library too and decoded again; a text has ``parity`` and
``round_trip`` if all its parts have.

Null and empty texts have no ids; repeated rows get equal results; a null
``doc_id`` stays null."""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dyad.llm.common import slices
from dyad.llm.tokens import SLICE_BYTES, ChunkEncoder

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, type
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True


def fields(raw: bytes):
    """``(number, value)`` of a protobuf message: ints, or bytes for lengths and fixed sizes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, raw[at : at + size]
        at += size


def parse(raw: bytes) -> Model:
    """Field numbers are those of the public sentencepiece_model.proto."""
    model = Model()
    for number, value in fields(raw):
        if number == 1:  # pieces
            piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:  # trainer_spec
            spec = dict(fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:  # normalizer_spec
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.strip_spaces, model.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models")
    return model


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs that make a piece, the best piece first."""
    ids = {p: i for i, (p, _, _) in enumerate(pieces)}
    found = []
    for i, (piece, score, kind) in enumerate(pieces):
        if kind in (NORMAL, USER_DEFINED, UNUSED):
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in ids and b in ids:
                    found.append((-score, i, ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model):
    """The model as a ``tokenizers.Tokenizer``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model.pieces), unk_token=model.pieces[unknown][0],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if words_are_separate(model) and model.kind == BPE:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"(?<=[^{MARKER}])(?={MARKER})"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(),
                                           *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


def words_are_separate(model: Model) -> bool:
    """No piece has a marker after another character."""
    return not any(re.search(f"[^{MARKER}]{MARKER}", p) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


class PieceEncoder(ChunkEncoder):
    """Encoder that checks what it encodes against ``sentencepiece`` and its own decoder."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # batches are encoded by several threads
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        import sentencepiece

        with open(path, "rb") as f:
            model = parse(f.read())
        separate = words_are_separate(model) and not model.charsmap and not model.strip_spaces and model.dummy_prefix and model.escape_spaces
        super().__init__(build(model), "", f"  |^ | $|{MARKER}" if separate else "")
        self._reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unlike: set[str] = set()
        self.lossy: set[str] = set()

    def _encode(self, texts: list[str]) -> list[bytes]:
        made = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [e.ids for e in made]
        self.unlike.update(t for t, a, b in zip(texts, ids, self._reference.encode(texts, num_threads=1)) if a != b)
        self.lossy.update(t for t, back in zip(texts, self.decode(ids)) if t != back)
        return [np.array(x, "<u4").tobytes() for x in ids]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self._tokenizer.decode_batch(ids, skip_special_tokens=False)

    def free_of(self, texts: list[str | None], parts: set[str]) -> list[bool]:
        """Which texts have none of ``parts`` as a chunk or whole."""
        if not parts:
            return [True] * len(texts)
        return [t is None or (t not in parts and parts.isdisjoint(t.split(" "))) for t in texts]


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id``, the ``ids`` (array, if asked for), ``n_tokens``,
    ``ids_crc32`` (little-endian unsigned 32-bit ids), ``parity``, ``round_trip``."""
    path = model or default_model()

    def run(batches):
        own = piece_encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), SLICE_BYTES):
                part = texts.slice(a, b - a)
                ids, lengths = own.encode(part)
                stop = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(stop.tolist(), lengths.tolist())]
                values = part.to_pylist() if own.unlike or own.lossy else [None] * len(part)
                arrays = [batch.column(0).slice(a, b - a), pa.array(lengths), pa.array(crc, pa.int64()),
                          pa.array(own.free_of(values, own.unlike)), pa.array(own.free_of(values, own.lossy))]
                names = ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids`` (null ids: null text)."""
    path = model or default_model()

    def run(batches):
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = piece_encoder(path).decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts)], pa.string())],
                                             names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

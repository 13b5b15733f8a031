"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has a white-space marker after another character, so no
merge crosses the start of a marked word: the text can be cut before each run
of markers, each distinct chunk can be segmented once, and the ids of a text are
the chunks' ids joined by position. The table is built by each task as it
reads (a batch's new chunks are segmented together by the library) and emptied
at TABLE_ENTRIES chunks, so memory is bounded and no position is shuffled.

The cut is valid only for models with such pieces and the identity normalizer
with a dummy prefix and kept white space; check_model() tests the pieces and the
prefix, and refuses other models.

Defined cases: null and empty texts have only the begin and end ids and decode
to the empty text; texts of only spaces are one chunk; repeated rows and null ids
give a row each; other columns don't matter, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, trimmed

MARK = "▁"
TABLE_ENTRIES = 200_000
#: Texts of one step: no step holds more characters than this, or one text.
STEP_CHARS = 1_000_000
_SPACED = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunk_keys(text: str) -> list[str]:
    """The text's marked words, each without its first marker and with further
    markers as spaces, so that the library, which adds one, segments it alike."""
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    return [m.group()[1:].replace(MARK, " ") for m in _SPACED.finditer(MARK + text.replace(" ", MARK))] if text else []


def check_model(sp) -> None:
    crossing = next((i for i in range(sp.vocab_size()) if re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i))), None)
    if crossing is not None or sp.encode("a  b ", out_type=str)[0][0] != MARK or sp.decode(sp.encode("a  b ")) != "a  b ":
        raise ValueError("this model's pieces cross white-space markers or its normalizer changes white space")


class Codec:
    """One worker's processor and its chunk table."""

    def __init__(self, model: str | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model or default_model())
        check_model(self.sp)
        self.alone = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.table: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, begin and end included, as little-endian uint32."""
        keys = [chunk_keys(t) for t in texts]
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        new = [k for k in set().union(*keys) if k not in self.table]
        for k, ids in zip(new, self.sp.encode(new, num_threads=1)):
            self.table[k] = np.array(ids, "<u4").tobytes()
        if "" in self.table:  # a single marker: the library adds none to an empty text
            self.table[""] = self.alone
        get = self.table.__getitem__
        return [self.begin + b"".join(map(get, ks)) + self.end for ks in keys]

    def decode(self, ids: Iterable[bytes]) -> list[str]:
        return self.sp.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)


def steps(texts: pa.Array) -> Iterable[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size > STEP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


#: What encode_documents() can return, beside the id.
OUTPUTS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_DDL = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, model: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids again; outputs are names of OUTPUTS."""
    frame = bounded_batches(docs).select(docs[key].cast("long").alias(key), docs[text].cast("string").alias(text))

    def run(batches):
        codec = Codec(model)
        for b in batches:
            at = 0
            for part in steps(b.column(1)):
                packed = codec.encode(part)
                cols = {}
                if {"decoded", "decoded_sha256"} & set(outputs):
                    cols["decoded"] = codec.decode(packed)
                made = {
                    "n_tokens": lambda: [len(x) // 4 for x in packed],
                    "ids": lambda: [np.frombuffer(x, "<i4") for x in packed],
                    "decoded": lambda: cols["decoded"],
                    "ids_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in packed],
                    "decoded_sha256": lambda: [hashlib.sha256(x.encode()).hexdigest() for x in cols["decoded"]],
                }
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), *(pa.array(made[o](), OUTPUTS[o]) for o in outputs)], names=[key, *outputs])
                at += len(part)
        trimmed()

    return frame.mapInArrow(run, ", ".join([f"`{key}` long", *(f"{o} {_DDL[o]}" for o in outputs)]))


def decode_ids(frame: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of an array<int> column; null ids decode to the empty text."""

    def run(batches):
        codec = Codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.sp.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "decoded"])

    return frame.select(frame[key].cast("long").alias(key), frame[ids].cast("array<int>").alias("ids")).mapInArrow(run, f"`{key}` long, decoded string")


def query(spark, sf_dir):
    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))

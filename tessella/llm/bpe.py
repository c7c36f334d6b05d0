"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file becomes a tokenizers model: each byte is shown as one printable character, and
every split of a token into two others is a merge, ranked as the token. A text is cut where white
space follows anything else, and where a mark such as a comma follows a letter or digit; the split
pattern always cuts there too and never looks back, so each distinct piece is encoded once.

Cases: a null text counts as empty and has no tokens; null ids decode to no bytes. Repeated rows
give repeated results, an empty table an empty one, and other columns pass through untouched
(a column named as an output is replaced). Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import fresh, named, slices

#: Unicode's White_Space, as the split pattern's \s has it.
SPACE = r" \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = frozenset(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CHUNK = re.compile(rf"[{SPACE}]*[^\W_]++(?=[.,!?*%&$|])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Pieces whose ids a worker keeps at most, for as long as a task runs: some 60 MB. Workers are reused, so more would stay in memory.
KEPT_PIECES = 100_000


def byte_table() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        table = byte_table()
        show = lambda token: "".join(table[b] for b in token)
        merges = [
            (show(token[:cut]), show(token[cut:]))
            for token in sorted(ranks, key=ranks.get)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        size = max(ranks.values()) + 1
        byte_of = {c: b for b, c in enumerate(table)}
        self.bytes_of = [b""] * size
        for shown, rank in self.tokenizer.get_vocab().items():
            self.bytes_of[rank] = bytes(byte_of[c] for c in shown)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int32)
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [CHUNK.findall(t) for t in texts]
        wanted = set().union(*pieces) if pieces else set()
        new = list(wanted.difference(self.kept))
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept.clear()
            new = list(wanted)
        # pieces that start with white space and end without are encoded many in a row, as the cuts between them hold
        joined = [p for p in new if p[0] in SPACE_CHARS and p[-1] not in SPACE_CHARS]
        for at in range(0, len(joined), 500):
            part = joined[at : at + 500]
            self._keep(part, self._ids(["".join(part)])[0])
        rest = [p for p in new if p[0] not in SPACE_CHARS or p[-1] in SPACE_CHARS]
        for piece, ids in zip(rest, self._ids(rest), strict=True):
            self.kept[piece] = ids.tobytes()
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, p)), np.int32) for p in pieces]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: list[str], ids: np.ndarray) -> None:
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in pieces])) + 1
        start = 0
        for piece, end in zip(pieces, ends, strict=True):
            self.kept[piece] = ids[start:end].tobytes()
            start = end

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


INTS = T.ArrayType(T.IntegerType(), True)
IDS, ENDS = T.StructField("ids", INTS), T.StructField("ends", INTS)
DECODED, DECODED_TEXT = T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())


def _appended(df: DataFrame, run, fields: list[T.StructField], reads: str, path: str, pattern: str) -> DataFrame:
    """df with the fields that run makes, with a codec, from the column reads, a slice of rows at a time."""
    others = [f for f in df.schema.fields if f.name not in {x.name for x in fields}]
    schema = T.StructType([*others, *fields])
    source = df.select(*[named(f.name) for f in others], named(reads).alias(fresh(df, "own")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        try:
            for part in slices(batches):
                columns = [part.column(k) for k in range(len(others))]
                yield pa.RecordBatch.from_arrays([*columns, *run(own, part.column(len(others)))], names=[f.name for f in schema.fields])
        finally:
            own.kept.clear()

    return source.mapInArrow(each, schema)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _encoded(own: Codec, column: pa.Array) -> list[np.ndarray]:
    return own.encode(["" if t is None else t for t in column.to_pylist()])


def _ends(own: Codec, found: list[np.ndarray]) -> pa.Array:
    return _lists([np.cumsum(own.lengths[v], dtype=np.int32) for v in found])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Adds ids array<int> and, if asked for, ends array<int>: the byte of the text's UTF-8 form at which each token ends."""

    def run(own: Codec, column: pa.Array) -> list[pa.Array]:
        found = _encoded(own, column)
        return [_lists(found), *([_ends(own, found)] if offsets else [])]

    return _appended(df, run, [IDS, *([ENDS] if offsets else [])], text, path, pattern)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds decoded binary, the exact bytes of the ids, and decoded_text, in which a character that is split at the end of the ids shows as U+FFFD."""

    def run(own: Codec, column: pa.Array) -> list[pa.Array]:
        found = [own.decode(v or []) for v in column.to_pylist()]
        return [pa.array(found, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in found], pa.string())]

    return _appended(df, run, [DECODED, DECODED_TEXT], ids, path, pattern)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids array<int> and decoded binary, the bytes of those ids: both directions in one Python worker, as two
    operators in a row would hold two workers with a codec each for every core."""

    def run(own: Codec, column: pa.Array) -> list[pa.Array]:
        found = _encoded(own, column)
        return [_lists(found), pa.array([own.decode(v.tolist()) for v in found], pa.binary())]

    return _appended(df, run, [IDS, DECODED], text, path, pattern)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded bytes."""
    coded = encode_and_decode(df.select("doc_id", "text"), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

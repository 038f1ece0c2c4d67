"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is read once on the driver and broadcast (a vocabulary's size is
fixed).  Long texts are cut before white space that follows a non-space: no
match of ``public_tokenizers.PATTERN`` runs from a non-space into white space,
so every such place is a match boundary and the ids are those of the whole text.
A long run of white space, which the library's pattern matcher can't hold, is
one match by the pattern's own rule: the run without its last character if a
non-space follows, else the whole run.  It is encoded as one piece.

Both rules hold for that pattern alone; with another one a text is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kbloom.llm._io import Shared, shielded, table

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Texts of more characters are encoded in pieces of about this many.
PIECE_CHARS = 1 << 16

#: Runs of so many white-space characters are encoded by rule.
LONG_RUN = 1 << 12

# The code points that the pattern takes for white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{SPACES}])[ \n]")
_RUN = re.compile(f"(?<![{SPACES}])[{SPACES}]{{{LONG_RUN},}}")


class Encoder:
    """The library's encoding of a rank file, for texts of any length."""

    def __init__(self, held: tuple[bytes, str, bool]):
        import tiktoken

        data, pattern, self.cuts = held
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or not self.cuts:
            return self.library.encode_ordinary(text)
        out: list[int] = []
        for part, whole in stretches(text):
            if whole:
                out += self.library._core_bpe.encode_single_piece(part.encode())
            else:
                for piece in pieces(part):
                    out += self.library.encode_ordinary(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is one match of white space."""
    at = 0
    for run in _RUN.finditer(text):
        if run.start() > at:
            yield text[at : run.start()], False
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    if at < len(text):
        yield text[at:], False


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at safe boundaries; joined, the pieces are the text."""
    lo = 0
    while len(text) - lo > size:
        cut = _SAFE.search(text, lo + size)
        if cut is None:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:]


def load_ranks(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """Broadcast a rank file and its splitting pattern."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as held:
        return Shared(spark, (held.read(), pattern, pattern == public_tokenizers.PATTERN))


def _digest(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.once(Encoder)
        for batch in batches:
            texts = batch.column(1)
            n, ids_hash, back = [], [], []
            for i in range(batch.num_rows):
                ids = encoder.encode(texts[i].as_py() or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: token count, hash of the ids and hash of the decoded bytes.

    A null or empty text has no tokens; rows that repeat an id are encoded each.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_digest(load_ranks(spark)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.once(Encoder)
        for batch in batches:
            at, held = 0, 0
            rows: list[list[int]] = []
            for i in range(batch.num_rows):
                rows.append(encoder.encode(batch.column(0)[i].as_py() or ""))
                held += len(rows[-1])
                if held > 1 << 20 or i + 1 == batch.num_rows:
                    part = batch.slice(at, len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), *part.columns[1:]], ["token_ids", *part.schema.names[1:]])
                    at, rows, held = at + len(rows), [], 0

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with token_ids in place of text; a null text is empty.

    A column of ``docs`` that is itself called token_ids is ``_kept_token_ids``.
    """
    docs, _ = shielded(docs, "token_ids")
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*StructType.fromDDL("token_ids array<int>").fields, *others])
    return docs.select("text", *[f.name for f in others]).mapInArrow(_encode_rows(load_ranks(spark, path, pattern)), schema)


def _decode_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.once(Encoder)
        for batch in batches:
            data = [encoder.decode(ids.as_py() or []) for ids in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), *batch.columns[1:]], ["data", *batch.schema.names[1:]])

    return run


def decode_documents(spark: SparkSession, encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The raw bytes of each row's token_ids; null ids give no bytes.

    A column of ``encoded`` that is itself called data is ``_kept_data``.
    """
    encoded, _ = shielded(encoded, "data")
    others = [f for f in encoded.schema.fields if f.name != "token_ids"]
    schema = StructType([*StructType.fromDDL("data binary").fields, *others])
    return encoded.select("token_ids", *[f.name for f in others]).mapInArrow(_decode_rows(load_ranks(spark, path, pattern)), schema)

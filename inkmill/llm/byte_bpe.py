"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than ``CHUNK`` characters are cut first at boundaries that no match of the splitting
pattern can span, so that the library never holds a long text's whole match list and its cost stays
linear: a cut is made only before a single white-space character that follows a letter or digit and
precedes a letter or digit.  With the pattern given such a space always begins a match of its own
(``" ?\\p{L}+"`` and the like, or ``\\s+``), and no match runs across it from the left.

Edge cases: a null text counts as empty and has no ids; equal ids of repeated rows are encoded one by
one; extra columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkmill.llm.session import small_batches

CHUNK = 16_384
_CUT = regex.compile(r"(?<=[\p{L}\p{N}])(?=\s[\p{L}\p{N}])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cut a text at safe boundaries into pieces of about ``size`` characters (longer where there is
    no boundary); the pieces' ids joined are the text's ids."""
    begin = 0
    while len(text) - begin > size:
        cut = _CUT.search(text, begin + size)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def encode(enc, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= CHUNK:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each row of (doc_id, text).

    ``ids`` is the array of token ids, ``decoded`` the bytes that they stand for.
    """
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if keep_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(enc, text.as_py())
                decoded = enc.decode_bytes(ids)
                row = [doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                for column, value in zip(out, row + ([ids, decoded] if keep_ids else [])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, fields)], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep_ids else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ddl)

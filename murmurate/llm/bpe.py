"""Byte-level BPE: encoding with tiktoken from a local rank file, and raw-byte decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean

#: A rank file is broadcast; larger ones are refused.
MAX_RANK_FILE_BYTES = 64 << 20

#: Texts longer than this are cut at safe boundaries before the pattern runs over them.
PIECE_CHARS = 1 << 16

#: Between an ASCII letter or digit and a space or line feed every match of the pattern ends:
#: letters, digits and contractions never run on into white space, the pattern has no
#: look-behind, and its look-ahead is used in white space only. What stands right of such a
#: place is matched as if the text began there.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
#: The pattern's look-ahead branch backtracks through runs of white space, and the library's
#: stack ends at long ones. Such a run, of whatever white space, is one match without its
#: last character, or whole at the text's end; it goes to the merges directly.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")

_cache: dict = {}


def _encoding(packed: bytes, pattern: str):
    import tiktoken

    key = (hash(packed), len(packed), pattern)
    if key not in _cache:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines()) if a}
        _cache.clear()
        _cache[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _cache[key]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """``text`` cut at safe boundaries into pieces of about ``size``, each with whether it is
    a single match of the pattern. Without a boundary a piece goes on to the next one.
    Encoding the pieces one by one equals encoding ``text``."""
    start = 0
    runs = [(m.start(), m.end() - (m.end() < len(text))) for m in _LONG_SPACE.finditer(text)]
    for cut, end in [*runs, (len(text), len(text))]:
        while cut - start > size:
            m = _SAFE.search(text, start + size, cut)
            if not m:
                break
            yield text[start : m.start()], False
            start = m.start()
        if cut > start:
            yield text[start:cut], False
        if end > cut:
            yield text[cut:end], True
        start = end


def encode_text(enc, text: str | None, size: int = PIECE_CHARS):
    """The ids of one text as a numpy array; null is an empty text."""
    import numpy as np

    if not text:
        return np.empty(0, np.int32)
    if len(text) <= size and not _LONG_SPACE.search(text):
        return enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32)
    return np.concatenate([np.asarray(enc._encode_single_piece(p.encode()) if single else enc.encode_ordinary(p), np.int32) for p, single in pieces(text, size)])


def _ranks(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:
        packed = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(packed) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{rank_file} is larger than {MAX_RANK_FILE_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(packed)


def _appended(df: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    keep = [c for c in df.columns if c.lower() != name.lower()]
    return keep, T.StructType([*(df.schema[c] for c in keep), T.StructField(name, kind)])


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``, an array of ints: the ids of the whole text, special tokens
    unknown (their strings are ordinary text).

    Null text counts as empty and gives an empty array. A column already named ``ids_col`` is
    replaced; all others stay. Texts of any length are encoded whole: long ones in pieces cut where
    matches end, long runs of any white space as the one match they are. Rows are independent, so repeated rows give repeated results,
    an empty table an empty one, and no row is shuffled. The rank file is read by the driver
    and broadcast, its size checked."""
    ranks = _ranks(df, rank_file)
    keep, schema = _appended(df, ids_col, T.ArrayType(T.IntegerType(), False))

    def run(batches):
        import numpy as np

        enc = _encoding(ranks.value, pattern)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            for lo in range(0, b.num_rows, 512) or [0]:
                part = [encode_text(enc, x.as_py()) for x in texts.slice(lo, 512)]
                offsets = np.zeros(len(part) + 1, np.int32)
                np.cumsum([len(x) for x in part], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *part])))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).slice(lo, 512) for c in keep), ids], names=[*keep, ids_col])

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col``: the raw bytes of the ids, which need not be valid UTF-8.

    Null ids give empty bytes; an id without a rank raises ``KeyError``. A column already named
    ``bytes_col`` is replaced; all others stay."""
    ranks = _ranks(df, rank_file)
    keep, schema = _appended(df, bytes_col, T.BinaryType())

    def run(batches):
        enc = _encoding(ranks.value, pattern)
        for b in batches:
            ids = b.column(b.schema.get_field_index(ids_col))
            for lo in range(0, b.num_rows, 512) or [0]:
                raw = [enc.decode_bytes(x.values.to_pylist()) if x.is_valid and len(x.values) else b"" for x in ids.slice(lo, 512)]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).slice(lo, 512) for c in keep), pa.array(raw, pa.binary())], names=[*keep, bytes_col])

    return df.mapInArrow(lean(run), schema)

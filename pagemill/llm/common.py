"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class Memo(dict):
    """A bounded memo: two generations of at most size entries; what was used lately outlives a change of generation.

    m.get(key) looks into the young generation only; m.fetch(key) also revives from the old one, or returns None.
    """

    def __init__(self, size: int = 250_000):
        super().__init__()
        self.size, self.old = size, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def fetch(self, key):
        value = self.old.get(key)
        return None if value is None else self.keep(key, value)

    def keep(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_HELD: dict = {}


def hold(name: str, release) -> None:
    """Say, at a task's start, whose memos this worker now fills; those of other operators are released.

    Workers outlive stages, and the memos of several stages together would not fit an executor.
    """
    for other in [k for k in _HELD if k != name]:
        _HELD.pop(other)()
    _HELD[name] = release


def texts(batch: pa.RecordBatch, column: str | int) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    at = batch.schema.get_field_index(column) if isinstance(column, str) else column
    return [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null ids count as the empty text. Remainder 2 is held out."""
    own = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(own.cast("string"), F.lit(""))) % 4


def slim(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text only, so that further columns can't clash with those an operator adds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)

"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python worker turns into objects at a time, and bytes of strings beyond which a block ends earlier.
STEP, STEP_BYTES = 256, 8 << 20


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in blocks of at most STEP rows and STEP_BYTES bytes of strings; a larger row is a block of its own."""
    held = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(held)
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = min(int(np.searchsorted(upto, before + STEP_BYTES, "right")), at + STEP)
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


_HELD: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task; only the latest, so that those of several operators don't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: T.StructType | str) -> DataFrame:
    """Runs a function over blocks of an Arrow batch (see blocks()); very long texts so come a few at a time.

    make() is called once in each task; what it returns takes {column: list of values} and gives {column: list or
    Arrow array} of the schema's columns, with as many rows as it likes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in blocks(batch):
                got = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker stays, and the next task needs memory of other sizes

    return df.mapInArrow(run, want)


def text_key(text: str = "text") -> list:
    """Two independent 64-bit hashes of a text as columns k1 and k2; null counts as a text of its own."""
    return [F.xxhash64(F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text), F.octet_length(F.col(text))).alias("k2")]


#: Maps A-Z to a-z and every ASCII character that is no letter or digit to a space; bytes from 0x80 stay.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def ascii_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(WORD_TABLE).split() if text else []

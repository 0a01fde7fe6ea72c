"""Runs of windows that share a minimizer (super-windows), and the Spark steps on them.

Each window of ``window`` symbols has an anchor: the least hash among its k-symbol
runs, the leftmost on ties.  Equal windows have equal anchors at equal offsets, so
windows only need to meet within the groups of one anchor.  Consecutive windows
with the same anchor position make a run: one row for many windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c
from . import _hashing as hs

#: Symbols that are hashed at once; longer texts are cut into blocks that overlap by a window.
BLOCK = 1 << 20
_POS = np.uint64((1 << 24) - 1)
#: Ids of texts (8 bytes each) up to this number are broadcast to pick the texts out; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return a if size == w else np.minimum(a[: len(a) - (w - size)], a[w - size :])


def runs(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, anchor hash, content hash) of the runs of a sequence of symbol hashes."""
    parts = []
    for at in range(0, max(1, len(h) - window + 1), BLOCK):
        part = _runs(h[at : at + BLOCK + window - 1], window, k)
        parts.append((part[0] + at, *part[1:]))
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(h: np.ndarray, window: int, k: int):
    m = len(h) - window + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        up, down = hs._powers(len(h))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
        n = len(h) - k + 1
        kh = hs.mix((total[k:] - total[:n]) * down[:n])
        order = (kh & ~_POS) | np.arange(n, dtype=np.uint64)
        anchor = sliding_min(order, window - k + 1) & _POS
        cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        start, end = np.concatenate(([0], cut)), np.concatenate((cut, [m]))
        content = hs.mix((total[end + window - 1] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return start, end - start, kh[anchor[start].astype(np.int64)].view(np.int64), content.view(np.int64)


def text_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A row's key of 16 bytes: its id (of an id that is no integer, 64 bits of its digest) and 64 bits of a hash of id and text.

    Rows with different integer ids never share a key; of rows that repeat in id and text the key is one, and so are their spans."""
    eight = lambda number: F.unhex(F.lpad(F.hex(number), 16, "0"))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    own = eight(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))) if whole else F.unhex(F.substring(F.md5(name.cast("binary")), 1, 16))
    return F.concat(own, eight(F.xxhash64(F.col(id_col).cast("string"), c.utf8(text_col))))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_key, _id, _text); ids keep their type."""
    return docs.select(text_key(docs, id_col, text_col).alias("_key"), F.col(id_col).alias("_id"), c.utf8(text_col).alias("_text"))


def id_kind(rows: DataFrame) -> str:
    return rows.schema["_id"].dataType.simpleString()


def run_rows(rows: DataFrame, symbols, window: int, k: int) -> DataFrame:
    """(_key, _id, anchor, content, start, n_windows) of every text of ``rows`` (_key, _id, _text)."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        found, counts = [], []
        for text in part.column(2).to_pylist():
            r = runs(symbols(text), window, k)
            found.append(r)
            counts.append(len(r[0]))
        owner = pa.array(np.repeat(np.arange(len(counts)), counts))
        start, n, anchor, content = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(owner), part.column(1).take(owner), pa.array(anchor), pa.array(content), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
            names=["_key", "_id", "anchor", "content", "start", "n_windows"],
        )

    return c.map_arrow(rows, make, f"_key binary, _id {id_kind(rows)}, anchor long, content long, start int, n_windows int")


def pick_texts(rows: DataFrame, lists: DataFrame, keys: DataFrame, how_many: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` (with _key) joined to ``lists`` (one row per _key): where the keys are few, they are broadcast so that only their texts are shuffled."""
    if how_many <= limit:
        rows = rows.join(F.broadcast(keys), "_key", "left_semi")
    return rows.join(lists, "_key")


def others(rows: DataFrame, keys: DataFrame, how_many: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    return rows.join(F.broadcast(keys) if how_many <= limit else keys, "_key", "left_anti")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def span_lists(spans: DataFrame) -> DataFrame:
    """(_key, spans): a text's distinct (from, to) spans in one array, bounded by its own length."""
    return spans.groupBy("_key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))

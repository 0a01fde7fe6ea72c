"""Suffix-array dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Windows of ``threshold`` bytes that may be equal meet by their anchors (see
``_superwindows``); each distinct piece of text around an anchor is one segment,
whatever the number of its copies.  A task sorts the suffixes of its segments,
takes the Burrows-Wheeler transform, and extends intervals backward breadth
first: level by level this sets the common-prefix length of neighbouring
suffixes in order of increasing value, and stops at the threshold.  Neighbours
that are still unset share at least ``threshold`` bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from . import _hashing as hs
from . import _superwindows as sw

THRESHOLD = 200
ANCHOR = 100
#: Bytes of segments that one transform takes.
TRANSFORM_BYTES = 400_000
#: Segments of one anchor above which its windows are dealt out one by one, by their hash.
HOT_SEGMENTS = 2_000
_TABLE = np.random.default_rng(97).integers(1, 2**64, 256, np.uint64)


def byte_symbols(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (small non-negative integers below 512) sorted by their suffixes to ``depth`` symbols or more, by prefix doubling."""
    n = len(text)
    packed = np.zeros(n, np.int64)
    h = 7
    padded = np.concatenate((text.astype(np.int64), np.full(h, -1)))
    for i in range(h):
        packed = packed * 512 + padded[i : i + n] + 1
    while True:
        order = np.argsort(packed, kind="stable")
        ranked = packed[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if h >= depth or rank[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        packed = rank * (n + 1) + second
        h *= 2


def common_prefixes(text: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, length of the common prefix of each suffix with the one before it, as far as below ``threshold``, else -1).

    Backward extension: an interval of suffixes that begin with w is extended by each symbol before it to the interval of c + w.
    If the right end of the new interval has no value yet, the value there is the length of w, and the interval goes to the next level."""
    n = len(text)
    order = suffix_order(text, threshold + 8).astype(np.int32)
    bwt = text[order - 1]  # the text is taken as a ring; its first symbol is a separator
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)  # row of the k-th suffix's predecessor in symbol order
    last_to_first = np.empty(n, np.int32)
    last_to_first[by_symbol] = np.arange(n, dtype=np.int32)
    same = bwt[by_symbol]
    joined = same[1:] == same[:-1]
    after = np.full(n, n, np.int32)  # the next row with the same symbol
    after[by_symbol[:-1][joined]] = by_symbol[1:][joined]
    before = np.full(n, -1, np.int32)
    before[by_symbol[1:][joined]] = by_symbol[:-1][joined]
    value = np.full(n + 1, -1, np.int16)
    value[0] = value[n] = 0
    left, right = np.array([0], np.int32), np.array([n], np.int32)
    for level in range(threshold):
        size = right - left
        total = int(size.sum())
        if not total:
            break
        starts = (np.cumsum(size) - size).astype(np.int32)
        row = np.arange(total, dtype=np.int32) + np.repeat(left - starts, size)
        is_first = before[row] < np.repeat(left, size)
        is_last = after[row] >= np.repeat(right, size)
        new_left = np.sort(last_to_first[row[is_first]])
        new_right = np.sort(last_to_first[row[is_last]]) + 1
        fresh = value[new_right] < 0
        left, right = new_left[fresh], new_right[fresh]
        value[right] = level
    return order, value[:n]


def repeated_positions(segments: list[bytes], threshold: int) -> list[np.ndarray]:
    """For each segment, the starts of its ``threshold``-byte strings that start elsewhere in these segments too."""
    sizes = np.array([len(s) for s in segments])
    text = np.zeros(int(sizes.sum()) + len(segments), np.int16)
    at, begin = 0, []
    for s in segments:  # a separator (0) stands before each segment
        begin.append(at + 1)
        text[at + 1 : at + 1 + len(s)] = np.frombuffer(s, np.uint8)
        text[at + 1 : at + 1 + len(s)] += 1
        at += len(s) + 1
    order, value = common_prefixes(text, threshold)
    # suffixes with fewer than threshold bytes to the end of their segment hold a separator and start no window
    end = np.repeat(np.array(begin) + sizes, sizes + 1)
    valid = (np.arange(len(text)) + threshold <= end) & (text > 0)
    deep = value == -1
    # two separators' windows may agree beyond a segment's end: only valid suffixes count, and these agree with valid ones alone
    shared = deep.copy()
    shared[:-1] |= deep[1:]
    mark = np.zeros(len(text), bool)
    mark[order[shared]] = True
    mark &= valid
    return [np.flatnonzero(mark[b : b + n]) for b, n in zip(begin, sizes.tolist(), strict=True)]


def _segments(threshold: int, hot: int):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        at = part.schema.get_field_index
        out: dict[str, list] = {k: [] for k in ("anchor", "part", "_key", "start", "once", "segment")}
        for key, text, paths in zip(part.column(at("_key")).to_pylist(), part.column(at("_text")).to_pylist(), part.column(at("paths")).to_pylist(), strict=True):
            for p in paths:
                a, n = p["start"], p["n_windows"]
                pieces = [(0, a, n)]
                if p["n_paths"] > hot:  # windows of a hot anchor one by one, equal ones in equal parts
                    spread = -(-p["n_paths"] // hot)
                    h = hs.window_hashes(byte_symbols(text[a : a + n + threshold - 1]), threshold)
                    deal = (h % np.uint64(spread)).astype(int)
                    cut = [0, *(np.flatnonzero(deal[1:] != deal[:-1]) + 1).tolist(), n]
                    pieces = [(int(deal[i]), a + i, j - i) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                for deal_to, b, m in pieces:
                    out["anchor"].append(p["anchor"])
                    out["part"].append(deal_to)
                    out["_key"].append(key)
                    out["start"].append(b)
                    out["once"].append(p["once"])
                    out["segment"].append(text[b : b + m + threshold - 1])
        if not out["part"]:
            return None
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _expand(threshold: int, limit: int):
    """Whole groups of (anchor, part) are gathered to about ``limit`` bytes for one transform."""

    def solve(group: list[tuple]) -> pa.RecordBatch:
        keys, a, b = [], [], []
        if any(g[4] for g in group):
            for g, at in zip(group, repeated_positions([g[5] for g in group], threshold), strict=True):
                if g[4] and len(at):  # copies of whole paths are known to repeat
                    cut = np.flatnonzero(np.diff(at) > 1) + 1
                    for x in np.split(at, cut):
                        keys.append(g[2])
                        a.append(g[3] + int(x[0]))
                        b.append(g[3] + int(x[-1]) + threshold)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["_key", "from", "to"])

    def run(batches):
        group, total, ready = [], 0, 0  # group[:ready] are whole groups
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if group and row[:2] != group[-1][:2]:
                    ready = len(group)
                    if total >= limit:
                        yield solve(group)
                        group, total, ready = [], 0, 0
                group.append(row)
                total += len(row[5]) + 1
        if group:
            yield solve(group)

    return run


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, threshold: int, anchor: int, hot: int = HOT_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """((_key, from, to) byte spans covered by repeated strings, (_key, _id, _text) rows)."""
    spark = docs.sparkSession
    rows = sw.keyed(docs, id_col, text_col)
    paths = sw.run_rows(rows, byte_symbols, threshold, anchor)
    compact = paths.groupBy("anchor", "content").agg(F.count("*").alias("n"))
    groups = compact.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("n_paths"), F.count_if(F.col("n") == 1).alias("n_once")).filter("total > 1")
    wanted = c.checkpoint(
        compact.join(groups, "anchor").filter("n > 1 OR n_paths > 1").select("anchor", "content", (F.col("n") == 1).alias("once"), F.when((F.col("n_paths") > 1) & (F.col("n_once") > 0), F.col("n_paths")).otherwise(F.lit(0)).cast("int").alias("n_paths"))
    )
    hits = c.stored(paths.join(wanted, ["anchor", "content"]).select("_key", "anchor", "content", "start", "n_windows", "once", "n_paths"), "byte-path-hits")
    whole = hits.filter("NOT once").select("_key", F.col("start").alias("from"), (F.col("start") + F.col("n_windows") + (threshold - 1)).alias("to"))
    branching = hits.filter("n_paths > 0")
    open_paths = branching.filter("once").select("_key", "anchor", "start", "n_windows", "once", "n_paths").unionByName(
        branching.filter("NOT once").groupBy("anchor", "content").agg(F.min(F.struct("_key", "start", "n_windows", "once", "n_paths")).alias("p")).select("p._key", "anchor", "p.start", "p.n_windows", "p.once", "p.n_paths")
    )
    lists = c.checkpoint(open_paths.groupBy("_key").agg(F.collect_set(F.struct("anchor", "start", "n_windows", "once", "n_paths")).alias("paths")))
    keys = lists.select("_key")
    picked = sw.pick_texts(rows, lists, keys, keys.count())
    segments = c.map_arrow(picked, _segments(threshold, hot), "anchor long, part int, _key binary, start int, once boolean, segment binary")
    dealt = segments.repartition(c.shuffle_partitions(spark), "anchor", "part").sortWithinPartitions("anchor", "part")
    found = dealt.mapInArrow(_expand(threshold, TRANSFORM_BYTES), "_key binary, from int, to int")
    return whole.unionByName(found), rows


FIELDS = "_id {}, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(with_spans: bool, digest: bool):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        at = part.schema.get_field_index
        texts = part.column(at("_text")).to_pylist()
        lists = part.column(at("spans")).to_pylist() if with_spans else [()] * len(texts)
        size, removed, n_spans, kept = [], [], [], []
        for text, spans in zip(texts, lists, strict=True):
            merged = sw.merge_spans([(s["from"], s["to"]) for s in spans or ()])
            out, a = [], 0
            for b, e in merged:
                out.append(text[a:b])
                a = e
            out = b"".join([*out, text[a:]])
            size.append(len(text))
            removed.append(len(text) - len(out))
            n_spans.append(len(merged))
            kept.append(hashlib.sha256(out).hexdigest().encode() if digest else out)
        return pa.RecordBatch.from_arrays([part.column(at("_id")), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept), one row per row of ``docs``; kept is what stays as bytes, or its SHA-256 in hex.

    A byte goes if a string of ``threshold`` bytes that covers it starts anywhere else, in the same row or another; strings
    overlap and are judged on the input.  Null texts count as empty; rows that repeat, null ids included, are texts
    of their own and so remove each other.  Kept bytes may break a character.  Other columns are not read."""
    spans, rows = repeated_spans(docs, id_col, text_col, threshold, anchor)
    lists = c.stored(sw.span_lists(spans), "repeated-bytes")
    keys = c.checkpoint(lists.select("_key"))
    n = keys.count()
    cut = c.map_arrow(sw.pick_texts(rows, lists, keys, n), _cut(True, digest), FIELDS.format(sw.id_kind(rows)))
    rest = c.map_arrow(sw.others(rows, keys, n), _cut(False, digest), FIELDS.format(sw.id_kind(rows)))
    return cut.unionByName(rest).select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_bytes(docs, digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT win.doc_id, win.p FROM win JOIN rep USING (g)),
isl AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
grp AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM isl),
span AS (SELECT doc_id, s, min(p) AS a, max(p) + 200 AS b FROM grp GROUP BY doc_id, s),
gaps AS (
  SELECT doc_id, b AS a, lead(a, 1, NULL) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM span
  UNION ALL SELECT doc_id, 0 AS a, min(a) AS b FROM span GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(d.h, 2 * g.a + 1, 2 * (coalesce(g.b, length(d.h) // 2) - g.a)), '' ORDER BY g.a) AS h FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id),
tot AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(tot.n, 0) AS BIGINT) AS n_removed, coalesce(tot.k, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN tot USING (doc_id)
"""

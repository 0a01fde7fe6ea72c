"""Token counts behind a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens): the tokenizer's
version digest, the digest of the normalised content, and the stored count.
Contents are joined to the cache; only distinct misses are encoded, and their
counts are appended.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from .bpe import tokenizer_path

#: Pieces whose counts a worker keeps (two generations).
MEMO_PIECES = 300_000
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def version_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts the ids that a tokenizer file's library gives for a text, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.cuts = False
        self.seen: list[dict[str, int]] = [{}, {}]
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count_all = lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
            return
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        self.count_all = lambda texts: [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            self.cuts = cuts_at_spaces(json.load(f))

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self.count_all(texts)
        pieces = [t.split(" ") for t in texts]
        memo, older = self.seen
        need = {}
        for ps in pieces:
            for p in ps:
                if p not in memo and p not in need:
                    if p in older:
                        memo[p] = older[p]
                    else:
                        need[p] = None
        todo = list(need)
        for a in range(0, len(todo), 10_000):
            need.update(zip(todo[a : a + 10_000], self.count_all(todo[a : a + 10_000]), strict=True))
        get = memo.get
        out = [sum([n if (n := get(p)) is not None else need[p] for p in ps]) for ps in pieces]
        memo.update((k, v) for k, v in need.items() if len(k) <= 64)
        if len(memo) > MEMO_PIECES:
            self.seen = [{}, memo]
        return out


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a text's tokens are those of its pieces between spaces: normalizers that act on each side alone, a splitter
    that drops everything but matches without white space, and special tokens without spaces."""
    parts = lambda x, key: x.get(key, [x]) if x else []
    norm = parts(spec.get("normalizer"), "normalizers")
    pre = parts(spec.get("pre_tokenizer"), "pretokenizers")
    ok_norm = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in norm)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ok_pre = bool(pre) and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and pre[0]["pattern"] == {"Regex": pattern}
    ok_rest = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
    return ok_norm and ok_pre and ok_rest and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])


def normalise(text: bytes, cuts: bool) -> bytes:
    """Content whose count is the same: where the tokenizer cuts at spaces, runs of ASCII white space become one space."""
    return b" ".join(text.split()) if cuts else text


def _counter(path: str) -> Counter:
    state = c.kept("token_counts")
    if path not in state:
        state.clear()
        state[path] = Counter(path)
    return state[path]


def digests(docs: DataFrame, vocabulary: str, cuts: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_bytes, digest): one row per document, without its text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(1).to_pylist()
        found = [hashlib.sha256(normalise(t, cuts)).digest() for t in texts]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.binary())], names=["_id", "n_bytes", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    return c.map_arrow(c.id_text(docs, id_col, text_col), run, f"_id {kind}, n_bytes long, digest binary")


def contents(docs: DataFrame, cuts: bool, text_col: str = "text") -> DataFrame:
    """(digest, content): each task's distinct contents, so that copies meet before the shuffle."""

    def run(batches):
        seen: set[bytes] = set()  # 16 bytes for each distinct text of one input split
        for batch in batches:
            for part in c.slices(batch, "_text"):
                keys, texts = [], []
                for t in part.column(0).to_pylist():
                    content = normalise(t, cuts)
                    d = hashlib.sha256(content).digest()
                    if d[:16] not in seen:
                        seen.add(d[:16])
                        keys.append(d)
                        texts.append(content)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], names=["digest", "content"])

    return docs.select(c.utf8(text_col).alias("_text")).mapInArrow(run, "digest binary, content binary")


def _encode_misses(misses: DataFrame, vocabulary: str) -> DataFrame:
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in c.slices(batch, "content"):
                keys, texts = [], []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if d[:16] not in seen:
                        seen.add(d[:16])
                        keys.append(d)
                        texts.append(t.decode("utf-8", "replace"))
                counts = _counter(tokenizer_path(vocabulary)).count(texts)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])
        c.tidy()

    return misses.mapInArrow(run, "digest binary, n_tokens long")


class DigestCache:
    """Append-only cache table in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, version: str) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).filter(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # appends of racing runs may repeat a digest

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): one row per row of ``docs``, repeated rows and null ids included; null texts count as empty.

    ``cache_path`` names a cache table in a shared folder; without one a new cache is made for this call.  Other columns
    of ``docs``, whatever their names, are not read."""
    spark = docs.sparkSession
    path = tokenizer_path(vocabulary)
    version, cuts = version_digest(path), _cuts(path)
    cache = DigestCache(spark, cache_path or c.scratch_path(spark, "token-counts"))
    stored = cache.read(version)
    found = contents(docs, cuts, text_col)
    misses = found.repartition("digest") if stored is None else found.join(stored.select("digest"), "digest", "left_anti").repartition("digest")
    cache.append(_encode_misses(misses, vocabulary), version)
    counts = cache.read(version)
    rows = digests(docs, vocabulary, cuts, id_col, text_col).join(counts, "digest")
    return rows.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cuts(path: str) -> bool:
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        return cuts_at_spaces(json.load(f))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(c.table(spark, sf_dir, "documents").select("doc_id", "text"))

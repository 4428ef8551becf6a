"""Token counts through a cache that is keyed by digests of the content and of the tokenizer's version."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from importlib import metadata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut, scratch, slices, table

#: Texts above this many tokens are over the limit.
LIMIT = 512
CACHE_SCHEMA = "version string, digest binary, n_bytes bigint, n_tokens bigint"
#: How byte-level BPE divides a text before merging: fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Names the tokenizer's file and library: stored counts hold for this version alone."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library} {metadata.version(library)}".encode()).hexdigest()[:32]


def _quick(t):
    """A faster encoder with the same counts for plain Latin text, or None if the file's rules differ from it.

    It is used where nothing depends on special strings or on versions of Unicode: printable ASCII, line feeds and
    the Latin letters of U+00C0 to U+024F but for the two signs among them. It needs byte-level BPE with merges
    in order of ids.
    """
    spec = json.loads(t.to_str())
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get("".join(m)) for m in merges]
    if None in made or any(x >= y for x, y in zip(made, made[1:])):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {a["content"] for a in spec.get("added_tokens") or []}
    ranks = {bytes(code[c] for c in k): v for k, v in vocab.items() if k not in special}
    if any(len(k) == 1 and v >= min(made, default=256) for k, v in ranks.items()) or len(ranks) != len(merges) + 256:
        return None
    import tiktoken

    fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("|".join([r"[^\x20-\x7e\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", *map(re.escape, special)]))
    return fast, odd


def _encoder(path: str):
    """counts(texts) for the file, kept by each Python worker."""
    if path not in _LOADED:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            quick = _quick(t)

            def counts(texts: list[str]) -> list[int]:
                out, rest = [0] * len(texts), []
                for i, x in enumerate(texts):
                    if quick and not quick[1].search(x):
                        out[i] = len(quick[0].encode_ordinary(x))
                    else:
                        rest.append(i)
                for i, e in zip(rest, t.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                    out[i] = len(e)
                return out

            _LOADED[path] = counts
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(sp.encode(x)) for x in texts]
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; texts that the cache at `cache` lacks are encoded once and appended to it.

    The content is normalised by reading null as the empty text and taking its UTF-8 bytes; its key is their SHA-256.
    The rows are joined to the cache by digest and version; of those without a count, one row per digest is kept,
    and only that row's text is encoded. Copies, however many, cost one encoding, and a group of copies is reduced
    before the shuffle. Nulls and empty texts count 0; a row whose id and text repeat gives one row each time (and is encoded each time); an empty table gives
    none; the tables' other columns are not read. The append is a new file set, so runs may share a cache; two runs
    that miss the same text at once both store it, and one count is read.
    """
    spark = docs.sparkSession
    version = version_digest(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("digest", F.unhex(F.sha2(F.col("t").cast("binary"), 256)))
    known = _read(spark, cache).where(F.col("version") == version)
    slim = cut(keyed.select("id", "digest", F.octet_length("t").cast("bigint").alias("n_bytes")))
    misses = slim.groupBy("digest").agg(F.min("id").alias("id")).join(known.select("digest"), "digest", "left_anti")
    # the ids of missing texts are the build side; the texts stream past them unsorted
    same = (keyed["digest"] == misses["digest"]) & keyed["id"].eqNullSafe(misses["id"])
    chosen = keyed.join(misses.hint("shuffle_hash"), same, "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in slices(batches, "t"):
            texts = batch.column("t")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([version] * batch.num_rows),
                    batch.column("digest").cast(pa.binary()),
                    pc.cast(pc.binary_length(texts.cast(pa.binary())), pa.int64()),
                    pa.array(count(texts.to_pylist()), pa.int64()),
                ],
                names=["version", "digest", "n_bytes", "n_tokens"],
            )

    chosen.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = _read(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    counts = cut(counts)
    return slim.hint("merge").join(counts.hint("merge"), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def _read(spark: SparkSession, cache: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for all documents, through a cache of this run's own, so that its figures hold every encoding."""
    docs = table(spark, sf_dir, "documents")
    cache = f"{scratch(spark, 'token-cache')}/counts"
    counted = count_tokens(docs, tokenizer_file(), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

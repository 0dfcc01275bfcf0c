"""Packing by power-of-two decomposition (operator 3).

A document's token ids, with the end id behind them, are cut into pieces whose lengths are
powers of two: as many of the sequence length as fit, then the binary digits of the rest,
largest first. Every piece is a sequence of its own, so no sequence crosses documents and
none needs padding; a loader batches pieces of one bucket, which are equally long.
No shuffle is needed, and a task holds one slice of texts at a time.

Null text: empty, one piece with the end id alone. A null doc_id stays null. Repeated rows
are packed one by one. A very long text is encoded whole, in the memory of one task, whatever it
repeats. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palaver.llm import text as tx
from palaver.llm.shared import arrow_rows, lean

LENGTH = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k"
#: Texts of these characters alone split alike in both libraries; any other goes to tokenizers.
COMMON = tx.regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ]*")
#: Longer runs of blanks, or of anything else, overflow tiktoken's splitter; they go to tokenizers.
LONGEST_RUN = 10_000
_RUNS = tx.regex.compile(r"\s+|\S+")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def long_run(text: str) -> bool:
    return len(text) > LONGEST_RUN and any(m.end() - m.start() > LONGEST_RUN for m in _RUNS.finditer(text))


@lru_cache(maxsize=2)
def tokenizer(folder: str | None, vocabulary: str):
    """encode(list of texts) -> lists of ids, as tokenizers gives for the vocabulary's .json.

    The ranks file beside it holds the same vocabulary for tiktoken, whose encoder takes an
    eighth of the time. Texts with other than common characters, with the string of the
    special token, or with a run of blanks or of other characters beyond LONGEST_RUN, are
    encoded by tokenizers itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    where = (lambda f: f"{folder}/{f}") if folder else public_tokenizers.path
    exact = Tokenizer.from_file(where(f"{vocabulary}.json"))
    with open(where(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list:
        out = []
        for t in texts:
            if COMMON.fullmatch(t) and "<|" not in t and not long_run(t):
                out.append(fast.encode_ordinary(t))
            else:
                out.append(exact.encode(t, add_special_tokens=False).ids)
        return out

    return encode


def pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids."""
    out = [(i * length, length) for i in range(n // length)]
    at, rest = n // length * length, n % length
    for k in range(length.bit_length() - 1, -1, -1):
        if rest >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def pack(docs: DataFrame, length: int = LENGTH, tokenizers_dir: str | None = None, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    length must be a power of two. With with_ids, the ids themselves follow as array<int>.
    sequence_id holds the scan's partition in its upper bits, so it is unique without a
    shuffle and the same when a task runs again. bucket is the piece's length.
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")

    def run(batches):
        encode = tokenizer(tokenizers_dir, vocabulary)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for at, part in tx.chunks(texts, 1 << 21):
                out = [[] for _ in range(6)]
                kept = []
                for i, ids in enumerate(encode(["" if t is None else t for t in part.to_pylist()])):
                    ids = np.array(ids + [END_ID], dtype="<u4")
                    key, raw = doc_ids[at + i].as_py(), memoryview(ids).cast("B")
                    for start, n in pieces(len(ids), length):
                        for col, v in zip(out, (key, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(ids), n), strict=True):
                            col.append(v)
                        if with_ids:
                            kept.append(ids[start : start + n].astype(np.int32))
                kinds = [pa.int64()] * 5 + [pa.int32()]
                cols = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    arrow_rows(docs.sparkSession, 2000)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SCHEMA + ", ids array<int>" * with_ids)
    first = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return rows.select(*first, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *["ids"] * with_ids)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

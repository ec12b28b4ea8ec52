"""Packing by power-of-two decomposition.

A document of n tokens is cut, from its start, into whole sequences of ``longest`` tokens and then into pieces of the lengths of the set
bits of the rest, largest first. Every piece is a sequence of its own: no sequence crosses documents, none is padded, and pieces of one
length form a bucket, from which batches of equal shape are drawn.

Defined cases: null and empty texts are the end token alone, one piece of length 1; texts of any length are taken whole; repeated rows
are packed each for itself; other columns are ignored. Sequence ids are gapless in the order of doc_id (nulls first), length of the
document and content, so reruns agree.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.llm.common import cut, running_total, table

LONGEST = 1024
END = 0
LONG = re.compile(r"\s{2000}|\S{2000}")


def encoder(tokenizer_file: str, ranks_file: str, pattern: str, special: dict[str, int]):
    """A function from text to an array of the ids that the tokenizers library gives with ``tokenizer_file`` and add_special_tokens=False.

    Most texts get the same ids from tiktoken, with the same vocabulary as ranks, in a fifth of the time; texts with a run of ``LONG``
    or more characters of white space, or of others, on which tiktoken's pattern can exhaust its stack, go to tokenizers itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    made = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(tokenizer_file)

    def encode(text: str) -> np.ndarray:
        if LONG.search(text):
            return np.array(slow.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        return made.encode_to_numpy(text, allowed_special="all")

    return encode


def default_encoder():
    import public_tokenizers

    files = (str(public_tokenizers.path(f"byte_bpe_50k.{kind}")) for kind in ("json", "tiktoken"))
    return encoder(*files, public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of ``n`` tokens in order; ``longest`` is a power of two."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def tokenised(docs: DataFrame, make_encoder=default_encoder, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, doc_tokens, pieces: array<struct<start, length, ids_crc32>>)`` for each row, the end token counted."""
    schema = "doc_id long, doc_tokens long, pieces array<struct<start: long, length: long, ids_crc32: long>>"
    made = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            totals, begins, starts, lengths, sums = [], [0], [], [], []
            for text in batch.column(1):
                ids = np.append(encode(text.as_py() or ""), END).astype("<u4")
                at = 0
                for length in piece_lengths(len(ids), longest):
                    starts.append(at)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[at : at + length]))
                    at += length
                totals.append(at)
                begins.append(len(starts))
            pieces = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, sums)], fields=list(made.value_type))
            pieces = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pieces).cast(made)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pieces], names=["doc_id", "doc_tokens", "pieces"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, make_encoder=default_encoder, longest: int = LONGEST) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket``; bucket is log2 of the length."""
    order = F.col("doc_id").asc_nulls_first(), F.col("doc_tokens"), F.hash("pieces")
    rows = running_total(cut(tokenised(docs, make_encoder, longest), "tokens"), F.size("pieces"), *order, name="packing")
    pieces = rows.select("doc_id", "doc_tokens", "before", F.posexplode("pieces").alias("at", "piece"))
    return pieces.select(
        "doc_id",
        "piece.start",
        "piece.length",
        "piece.ids_crc32",
        "doc_tokens",
        (F.col("before") + F.col("at")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("piece.length").cast("int").alias("bucket"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but 16-bit big-endian token ids, each document ended by an end-of-document id (``EOD``); padding (``PAD``) may
fill the end of a file. No file is read as a whole: Spark's text reader splits files of any size into byte ranges and cuts these at a fixed byte, and
the pieces of a range are put together again into blocks. In each block a vectorised search finds the separators, which gives the lengths of the
documents inside and two open ends. Where a block begins isn't known until the bytes before it are counted, so a block is summed up for both
parities of its place; a prefix scan over the blocks' sizes (a running sum over the blocks of a file) tells which one holds, and a
second one over the chosen summaries stitches documents that run across blocks and numbers them. Only summaries and counts are exchanged.

:func:`write_token_files` makes such files from texts with a public tokenizer, whose file is a parameter. Spark's own text writer
writes the bytes, so any store that Spark writes to will do: a row's last byte is the writer's line separator.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read, shared_dir, small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the tokenizer's vocabulary cuts a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The ids end in the byte of 'P', which the text writer adds as its line separator. The first is free in the vocabulary.
EOD, PAD, LAST = 50256, 65360, "P"
#: Files end on a multiple of so many bytes; a block has about so many bytes (a piece without the cutting byte is never split).
ALIGN, BLOCK = 4096, 1 << 19


def encoder(path: str = TOKENIZER):
    """A function from texts to their token ids."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """One flat file for each partition of ``docs``; documents in the order of their rows. Null and empty texts have no token, repeated rows are written again; an empty table has no document."""
    small_batches(docs.sparkSession)

    def run(batches):
        encode, size = encoder(tokenizer), 0
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                out.append((np.array(encode(text or ""), ">u2").tobytes() + EOD.to_bytes(2, "big"))[:-1])
                size += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if size % ALIGN:
            yield pa.RecordBatch.from_arrays([pa.array([(PAD.to_bytes(2, "big") * ((ALIGN - size % ALIGN) // 2))[:-1]], pa.binary())], ["value"])

    rows = docs.select("text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", LAST).text(path)


def manifest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, doc_no, key): the order in which :func:`write_token_files` writes the documents of the same table."""

    small_batches(docs.sparkSession)

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(np.arange(at, at + b.num_rows)), b.column(0)], ["part", "doc_no", key])
            at += b.num_rows

    return docs.select(F.col(key).cast("long")).mapInArrow(run, f"part int, doc_no long, {key} long")


def summary(tokens: np.ndarray, eod: int = EOD, pad: int = PAD) -> tuple[int, int, int, np.ndarray]:
    """(separators, tokens before the first, tokens after the last, lengths between) of a block; without one all tokens stand before and after."""
    at = np.flatnonzero(tokens == eod)
    padded = tokens == pad
    before = np.concatenate([[0], np.cumsum(~padded)]) if padded.any() else np.arange(len(tokens) + 1)
    if not len(at):
        return 0, int(before[-1]), int(before[-1]), np.zeros(0, np.int64)
    return len(at), int(before[at[0]]), int(before[-1] - before[at[-1] + 1]), (before[at[1:]] - before[at[:-1] + 1]).astype(np.int64)


def cutting_byte(eod: int, pad: int) -> int:
    """The byte that files are cut at: the separator's last one if it can be, else one that begins neither separator nor padding, so that a token across two blocks is neither."""
    able = [x for x in (eod & 255, *range(1, 128)) if 0 < x < 128 and x not in (eod >> 8, pad >> 8)]
    return able[0]


_SIDE = "struct<n:int,lead:long,tail:long,lengths:array<long>>"
_BLOCKS = f"file string, range long, nth int, bytes long, even {_SIDE}, odd {_SIDE}, even_less {_SIDE}, odd_less {_SIDE}"


def _side(data: bytes, odd: bool, eod: int, pad: int) -> dict:
    """The summary of a block that begins at an even or an odd place. A token belongs to the block where it begins, whose last byte, the cutting one, tells that it's an ordinary token."""
    body = np.frombuffer(data, np.uint8)[1 if odd else 0 :]
    n, lead, tail, lengths = summary(body[: len(body) // 2 * 2].view(">u2"), eod, pad)
    left = len(body) % 2  # the first byte of a token that ends in the next block
    return {"n": n, "lead": lead + left * (n == 0), "tail": tail + left, "lengths": lengths}


def blocks(spark: SparkSession, path: str, eod: int = EOD, pad: int = PAD) -> DataFrame:
    """(file, range, nth, bytes, even, odd, even_less, odd_less): the blocks of the byte ranges of all files under ``path``, summed up for both parities of their place.

    The reader doesn't tell whether a file ends in the cutting byte, so a range's last block is also summed up without it.
    """
    mark = bytes([cutting_byte(eod, pad)])
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", mark.decode()).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))

    def run(batches):
        at, nth, held, size = None, 0, [], 0

        def flush(last: bool):
            data = b"".join(held)
            row = {"file": at[0], "range": at[1], "nth": nth, "bytes": len(data), "even": _side(data, False, eod, pad), "odd": _side(data, True, eod, pad)}
            if last:
                row |= {"even_less": _side(data[:-1], False, eod, pad), "odd_less": _side(data[:-1], True, eod, pad)}
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for b in batches:
            for file, start, value in zip(b.column("file").to_pylist(), b.column("range").to_pylist(), b.column("value").to_pylist(), strict=True):
                if (file, start) != at or size >= BLOCK:
                    if held:
                        yield flush((file, start) != at)
                    at, nth, held, size = (file, start), nth + 1 if (file, start) == at else 0, [], 0
                held += (value, mark)
                size += len(value) + 1
        if held:
            yield flush(True)

    return lines.mapInArrow(run, _BLOCKS)


_HALF = pa.struct([("n", pa.int32()), ("lead", pa.int64()), ("tail", pa.int64()), ("lengths", pa.list_(pa.int64()))])
_ARROW = pa.schema([("file", pa.string()), ("range", pa.int64()), ("nth", pa.int32()), ("bytes", pa.int64()), *((x, _HALF) for x in ("even", "odd", "even_less", "odd_less"))])


def placed(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file, block, n, lead, tail, lengths): of each block the summary that its place asks for.

    ``sizes`` (file, size): where a file's last block passes its end, the cutting byte isn't there. The last byte of a file of odd size is no token.
    """
    order = W.partitionBy("file").orderBy("range", "nth")  # a file's blocks: summaries of half a megabyte each
    rows = found.withColumn("at", F.sum("bytes").over(order) - F.col("bytes")).withColumn("block", F.row_number().over(order)).withColumn("end", F.lead("nth").over(order).isNull())
    rows = rows.join(sizes, "file")
    past, even = F.col("end") & (F.col("at") + F.col("bytes") > F.col("size")), F.col("at") % 2 == 0
    rows = rows.withColumn("s", F.when(past & even, F.col("even_less")).when(past, F.col("odd_less")).when(even, F.col("even")).otherwise(F.col("odd")))
    less = F.when(F.col("end") & (F.col("size") % 2 == 1), 1).otherwise(0)
    return rows.select("file", "block", F.col("s.n").alias("n"), (F.col("s.lead") - F.when(F.col("s.n") == 0, less).otherwise(0)).alias("lead"), (F.col("s.tail") - less).alias("tail"), F.col("s.lengths").alias("lengths"))


def stitch(found: DataFrame) -> DataFrame:
    """(file, doc_no, n_tokens, last): every document of every file; tokens after a file's last separator make a document too (``last``)."""
    order = W.partitionBy("file").orderBy("block")  # a file's blocks: summaries of half a megabyte each
    rows = found.withColumn("segment", F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(order)).withColumn("docs", F.sum("n").over(order) - F.col("n"))
    open_end = F.sum("tail").over(W.partitionBy("file", "segment").orderBy("block"))
    rows = rows.withColumn("open", open_end).withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0))).withColumn("end", F.lead("block").over(order).isNull())
    inside = F.when(F.col("n") > 0, F.concat(F.array(F.col("carry") + F.col("lead")), "lengths")).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("end") & (F.col("open") > 0), F.array("open")).otherwise(F.array().cast("array<long>"))
    counts = rows.select("file", "docs", "n", F.posexplode(F.concat(inside, rest)).alias("at", "n_tokens"))
    return counts.select("file", (F.col("docs") + F.col("at")).alias("doc_no"), "n_tokens", (F.col("at") >= F.col("n")).alias("last"))


def count_tokens(spark: SparkSession, path: str, eod: int = EOD, pad: int = PAD) -> DataFrame:
    """(file, doc_no, n_tokens, last) for the token files under ``path``, whatever their size.

    An empty file holds no document, two separators in a row an empty one; the last byte of a file of odd length is no token. Equal documents each get their row.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    return stitch(placed(cut(blocks(spark, path, eod, pad)), files))


def part_number(file: Column) -> Column:
    return F.regexp_extract(file, r"part-(\d+)-[^/]*\z", 1).cast("int")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of every document, counted in token files that are written first; null and empty texts have no token, repeated rows each get their row, an empty table gives none."""
    docs = read(spark, sf_dir, "documents")
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path)
    counts = count_tokens(spark, path).select(part_number(F.col("file")).alias("part"), "doc_no", "n_tokens")
    return counts.join(manifest(docs), ["part", "doc_no"], "full").select("doc_id", "n_tokens")

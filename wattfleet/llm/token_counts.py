"""Token counts by a separator scan over flat, unindexed token streams.

A stream is a file of token ids in which an end-of-document id closes every document; there is no
index of where documents start. Streams are read in blocks of equal size, each block searched for
the id in one vectorised pass. Documents that cross blocks are stitched by prefix scans over one
small row per block: the running number of tokens, the running number of separators, and the
running place of the last separator. The scans are two-level, blocks within superblocks and then
superblocks, so that one huge stream isn't the work of one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattfleet.llm.common import saved
from wattfleet.llm.words import MARK, word_encoder

SUPER = 1024


def read_streams(spark: SparkSession, path: str, block_bytes: int = 4 << 20, id_bytes: int = 2) -> DataFrame:
    """Blocks (stream, block, tokens) of flat binary files. Only names and lengths are listed; each
    block is a byte range that its task reads by itself, so a file may have any size. An empty file
    has no block. block_bytes must be a multiple of id_bytes, an id's width. Tasks read by Arrow's
    file systems, so the path must lie in one that these know.
    """
    if block_bytes % id_bytes:
        raise ValueError("a block must hold whole ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, place = FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with files.open_input_file(place) as f:
                    at = block * block_bytes
                    data = f.read_at(min(block_bytes, f.size() - at), at)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["stream", "block", "tokens"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream"), "length")
    ranges = files.select("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0)))).alias("block"))
    return ranges.repartition("stream", "block").mapInArrow(run, "stream string, block long, tokens binary")


def write_streams(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Tokenises docs into one stream per input partition, in the shared folder: (blocks, manifest).

    blocks: stream, block, tokens; documents start anywhere in them. manifest: stream, ordinal, id -
    the order of documents, without their places. Texts of special tokens are ordinary text here,
    so that the end-of-document id occurs nowhere else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stream = word_encoder(vocabulary, False), str(TaskContext.get().partitionId())
        end = np.array([enc.mark], enc.kind).tobytes()
        size = block_tokens * enc.kind.itemsize
        rest, block, ordinal, kind = b"", 0, 0, None

        def rows(blocks: list[bytes], ids: pa.Array) -> pa.RecordBatch:
            a, b = len(blocks), len(ids)
            none = lambda n, t: pa.nulls(n, t)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(["block"] * a + ["document"] * b),
                    pa.array([stream] * (a + b)),
                    pa.array([*range(block, block + a), *range(ordinal, ordinal + b)], pa.int64()),
                    pa.concat_arrays([none(a, ids.type), ids]),
                    pa.concat_arrays([pa.array(blocks, pa.binary()), none(b, pa.binary())]),
                ],
                ["kind", "stream", "n", "id", "tokens"],
            )

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                ids, texts = batch.column(0)[k : k + 1000], batch.column(1)[k : k + 1000]
                kind = ids.type
                data = rest + b"".join([x + end for x in enc.encode(texts)])
                full = [data[i : i + size] for i in range(0, len(data) - size + 1, size)]
                rest = data[len(full) * size :]
                yield rows(full, ids)
                block, ordinal = block + len(full), ordinal + len(ids)
        if rest:
            yield rows([rest], pa.array([], kind))

    slim = docs.select(F.col(id_col), F.col(text_col))
    both = saved(slim.mapInArrow(run, f"kind string, stream string, n long, id {slim.schema[0].dataType.simpleString()}, tokens binary"), "streams")
    blocks = both.filter("kind = 'block'").select("stream", F.col("n").alias("block"), "tokens")
    return blocks, both.filter("kind = 'document'").select("stream", F.col("n").alias("ordinal"), F.col("id").alias(id_col))


def before(rows: DataFrame, by: str, order: str, values: dict[str, tuple]) -> DataFrame:
    """rows with, for each new column, an aggregate over all rows of the same `by` that come earlier.

    values: new column -> (aggregate, expression, value if nothing is earlier). Two levels: within
    superblocks of SUPER rows, and over superblocks.
    """
    rows = rows.withColumn("_super", F.floor(F.col(order) / SUPER))
    inner = Window.partitionBy(by, "_super").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(by).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = rows.groupBy(by, "_super").agg(*[f(x).alias(f"_{k}") for k, (f, x, _) in values.items()])
    supers = supers.select(by, "_super", *[f(F.col(f"_{k}")).over(outer).alias(f"_outer_{k}") for k, (f, _, _) in values.items()])
    rows = rows.withColumns({f"_inner_{k}": f(x).over(inner) for k, (f, x, _) in values.items()}).join(supers, [by, "_super"])
    join = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.max: lambda a, b: F.greatest(a, b)}
    out = {k: F.coalesce(join[f](F.col(f"_inner_{k}"), F.col(f"_outer_{k}")), F.lit(none)) for k, (f, _, none) in values.items()}
    return rows.withColumns(out).drop("_super", *[f"_{s}_{k}" for k in values for s in ("inner", "outer")])


def count_tokens(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """Documents of the streams: stream, ordinal, start (token in the stream), n_tokens (without the separator), complete.

    blocks: stream, block (0, 1, ... in order), tokens (whole ids of dtype). A stream's last tokens
    without a separator after them form a document that isn't complete. Documents may be empty; an
    empty stream has none. Blocks with null tokens count as empty; rows with a null stream form a
    stream. Bytes at a block's end that make no whole id are no token. A document may span any number
    of blocks, an empty table gives no rows. Other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for data in batch.column(2):
                raw = data.as_py() or b""
                ids = np.frombuffer(raw, dtype, len(raw) // np.dtype(dtype).itemsize)
                at = np.flatnonzero(ids == end_id)
                for c, x in zip(out, (len(ids), len(at), at)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["stream", "block", "size", "seps", "ends"])

    slim = blocks.select(F.coalesce(F.col("stream").cast("string"), F.lit("")).alias("stream"), F.col("block").cast("long"), "tokens")
    found = saved(slim.mapInArrow(scan, "stream string, block long, size long, seps long, ends array<long>"), "separators")
    small = before(found.select("stream", "block", "size", "seps", F.get("ends", F.col("seps").cast("int") - 1).alias("last")), "stream", "block", {"base": (F.sum, F.col("size"), 0), "earlier": (F.sum, F.col("seps"), 0)})
    small = before(small, "stream", "block", {"open": (F.max, F.col("base") + F.col("last") + 1, 0)})
    docs = found.select("stream", "block", "ends").join(small.select("stream", "block", "base", "earlier", "open"), ["stream", "block"])
    docs = docs.select("stream", "base", "earlier", "open", F.posexplode(F.transform(F.arrays_zip(F.concat(F.array(F.lit(None).cast("long")), "ends").alias("a"), F.col("ends").alias("b")), lambda p: p)).alias("k", "p")).filter("p.b IS NOT NULL")
    start = F.when(F.col("p.a").isNull(), F.col("open")).otherwise(F.col("base") + F.col("p.a") + 1)
    done = docs.select("stream", (F.col("earlier") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("p.b") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    tail = small.groupBy("stream").agg(F.sum("seps").alias("ordinal"), F.coalesce(F.max(F.col("base") + F.col("last") + 1), F.lit(0)).alias("start"), F.sum("size").alias("_all"))
    tail = tail.select("stream", "ordinal", "start", (F.col("_all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete")).filter("n_tokens > 0")
    return done.unionByName(tail)


def document_token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 18) -> DataFrame:
    """Writes docs as token streams, scans these, and gives each counted document its identifier back by its ordinal.

    Rows: id, stream, ordinal, start, n_tokens, complete. A null or empty text is a document of no
    tokens; null and repeated identifiers are carried, one row per row of docs. A very long text spans
    blocks, an empty table gives no rows, other columns are ignored.
    """
    blocks, manifest = write_streams(docs, vocabulary, id_col, text_col, block_tokens)
    enc = word_encoder(vocabulary, False)
    return manifest.join(count_tokens(blocks, enc.mark, enc.kind.str), ["stream", "ordinal"]).select(id_col, "stream", "ordinal", "start", "n_tokens", "complete")

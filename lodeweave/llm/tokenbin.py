"""Token ids on disk: bit-plane or byte-plane shuffled blocks, each plane compressed with zstandard.

The ids of all documents, in ascending order of document id and each closed by an end id, form one stream.
It is cut into files (one per range of document ids) and each file into blocks of a fixed number of ids. A
block's ids are transposed into planes - all lowest bytes, then all next bytes, or the same for bits - and
each plane is compressed on its own, so that planes which hardly vary cost next to nothing.

Files are parquet rows in a shared folder, one per block, so any store that Spark writes to can hold them, and the
committer takes care of lost and repeated tasks. A row is the block's entry of the chunk index - file_no, block_no,
first_id within the file, n_ids, plane_kind, ids_crc32, each plane's offset and size in the data, the documents that
touch the block (id, row_no, start_in_file, n_tokens) - and the data, all planes one after the other. Columnar files
keep the index apart from the data, so `TokenFiles.docs` and the file sizes read the index alone.

``write`` makes the files, ``read_pieces`` gives back the documents' pieces block by block in one narrow pass, and
``read_documents`` whole documents: those within a block straight from it, those that cross a border from their pieces,
which are all that is shuffled.

Ranges are cut by id, hash of the text and row, so an id that many rows share, or null, is spread over files. Cases: a
null or empty text is its end id alone; null document ids come first, repeated ones stand side by side, ordered by
their texts' hash, and stay apart by file and row_no; an empty table writes empty files; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_of

#: Ids in a block.
BLOCK_IDS = 1 << 16


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    press = zstandard.ZstdCompressor(level=level).compress
    if kind == "byte":
        return [press(np.ascontiguousarray(raw[:, i]).tobytes()) for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [press(np.packbits(bits[:, i], bitorder="little").tobytes()) for i in range(32)]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "byte") -> np.ndarray:
    """The ids of a block."""
    unpress = zstandard.ZstdDecompressor().decompress
    if kind == "byte":
        raw = np.stack([np.frombuffer(unpress(p, max_output_size=n_ids), np.uint8) for p in planes], axis=1)
    else:
        size = (n_ids + 7) // 8
        bits = np.stack([np.unpackbits(np.frombuffer(unpress(p, max_output_size=size), np.uint8), count=n_ids, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def _entry(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), *(T.StructField(n, T.LongType()) for n in ("row_no", "start_in_file", "n_tokens"))])


@dataclass
class TokenFiles:
    """What write() made: a table of blocks in a shared folder."""

    blocks: DataFrame
    id_col: str

    @property
    def docs(self) -> DataFrame:
        """The document's id, row_no, file_no, start_in_file, n_tokens, from the chunk index."""
        listed = self.blocks.select("file_no", "first_id", F.explode("docs").alias("d")).where("d.start_in_file >= first_id")
        return listed.select(F.col("d.id").alias(self.id_col), "d.row_no", "file_no", "d.start_in_file", "d.n_tokens")


def write(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = BLOCK_IDS, kind: str = "byte", level: int = 3) -> TokenFiles:
    """Encode, order and write all documents. kind: "byte" or "bit" planes."""
    entry = _entry(df.schema[id_col].dataType)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        *(T.StructField(n, T.LongType()) for n in ("file_no", "block_no", "first_id", "n_ids")),
        T.StructField("plane_kind", T.StringType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("plane_offsets", longs),
        T.StructField("plane_sizes", longs),
        T.StructField("docs", T.ArrayType(entry)),
        T.StructField("data", T.BinaryType()),
    ])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        from .tokenization import encoder

        encoded, arrow = encoder(tokenizer_path).encoded, to_arrow_schema(schema)
        file_no, block_no, at, row_no = TaskContext.get().partitionId(), 0, 0, 0
        held, listed = bytearray(), []

        def block(raw: bytes) -> pa.RecordBatch:
            nonlocal block_no, listed
            first, upto = block_no * block_ids, block_no * block_ids + len(raw) // 4
            planes = to_planes(np.frombuffer(raw, "<u4"), kind, level)
            sizes = [len(p) for p in planes]
            docs = [dict(zip(entry.names, d, strict=True)) for d in listed if d[2] < upto]
            listed = [d for d in listed if d[2] + d[3] > upto]
            row = (file_no, block_no, first, len(raw) // 4, kind, crc32(raw), [sum(sizes[:i]) for i in range(len(sizes))], sizes, docs, b"".join(planes))
            block_no += 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), end), strict=True):
                listed.append((key, row_no, at, len(ids) // 4))
                at, row_no = at + len(ids) // 4, row_no + 1
                held += ids
                done = 0
                while len(held) - done >= 4 * block_ids:
                    yield block(bytes(held[done : done + 4 * block_ids]))
                    done += 4 * block_ids
                if done:
                    del held[:done]
        if held:
            yield block(bytes(held))

    slim = df.select(F.col(f"`{id_col}`").alias("key"), text_of(f"`{text_col}`").alias("text"))
    order = ("key", "tie", "row")
    slim = slim.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    return TokenFiles(cut(ordered.mapInArrow(run, schema), "token_files"), id_col)


def file_starts(files: TokenFiles) -> DataFrame:
    """file_no, file_start: ids in all files before it. One row per file, summed in one small task."""
    sizes = files.blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    return sizes.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("file_start"))


def read_pieces(files: TokenFiles, wanted: str | None = None) -> DataFrame:
    """The pieces of all documents, one per block that a document touches: its id, file_no, row_no, block_no,
    start_in_file, n_tokens, ids (binary, little-endian unsigned 32-bit). wanted: an SQL condition on the block's columns
    and `d`, its entry of a document.
    """
    blocks = files.blocks
    if wanted is not None:
        blocks = blocks.withColumn("docs", F.expr(f"filter(docs, d -> {wanted})")).where("size(docs) > 0")
    id_type = files.blocks.schema["docs"].dataType.elementType["id"].dataType
    longs = [T.StructField(n, T.LongType()) for n in ("file_no", "row_no", "block_no", "start_in_file", "n_tokens")]
    schema = T.StructType([T.StructField(files.id_col, id_type), *longs, T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(batch.num_rows):
                r = {n: batch.column(i)[at] for i, n in enumerate(batch.schema.names)}
                n_ids, first = r["n_ids"].as_py(), r["first_id"].as_py()
                data = memoryview(r["data"].as_buffer())
                planes = [data[o : o + n] for o, n in zip(r["plane_offsets"].as_py(), r["plane_sizes"].as_py(), strict=True)]
                raw = from_planes(planes, n_ids, r["plane_kind"].as_py()).tobytes()
                if crc32(raw) != r["ids_crc32"].as_py():
                    raise ValueError(f"block {r['block_no']} of file {r['file_no']} is damaged")
                docs = r["docs"].values
                start, n = (docs.field(x).to_numpy(zero_copy_only=False) for x in ("start_in_file", "n_tokens"))
                a, z = np.maximum(start - first, 0) * 4, np.minimum(start + n - first, n_ids) * 4
                whole = [pa.repeat(r[x], len(docs)) for x in ("file_no", "block_no")]
                ids = pa.array([raw[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([docs.field("id"), whole[0], docs.field("row_no"), whole[1], docs.field("start_in_file"), docs.field("n_tokens"), ids], schema=arrow)

    columns = ("file_no", "block_no", "first_id", "n_ids", "plane_kind", "ids_crc32", "plane_offsets", "plane_sizes", "docs", "data")
    return blocks.select(*columns).mapInArrow(run, schema)


#: Whether a document lies within its block.
_WHOLE = "d.start_in_file >= first_id and d.start_in_file + d.n_tokens <= first_id + n_ids"


def read_documents(files: TokenFiles) -> DataFrame:
    """Every document from the files: its id, start (ids of all documents before it), n_tokens, ids (binary)."""
    cols = [files.id_col, "file_no", "start_in_file", "n_tokens", "ids"]
    whole, pieces = (read_pieces(files, w).select(F.col(f"`{files.id_col}`").alias("id"), "row_no", "block_no", *cols[1:]) for w in (_WHOLE, f"not ({_WHOLE})"))
    parted = pieces.groupBy("file_no", "row_no").agg(*(F.first(c).alias(c) for c in ("id", "start_in_file", "n_tokens")), F.sort_array(F.collect_list(F.struct("block_no", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(p["ids"] for p in parts) for parts in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], ["id", *cols[1:]])

    slim = ("id", *cols[1:])
    schema = whole.select(*slim).schema
    joined = parted.select("id", "file_no", "start_in_file", "n_tokens", "parts").mapInArrow(join, schema)
    docs = whole.select(*slim).unionByName(joined)
    # one row per file: as many as the session has shuffle partitions
    return docs.join(F.broadcast(file_starts(files)), "file_no").select(F.col("id").alias(files.id_col), (F.col("file_start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")

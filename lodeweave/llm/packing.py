"""Hierarchical multi-length packing of tokenised documents.

Each document becomes its ids and one end id. Whole windows of the largest context size are cut off first;
what is left is routed to the smallest context size (tier) that holds it. Tiers are packed from the longest
down: a window takes one document of its tier, its gap takes the largest fitting documents of shorter tiers,
and a last gap takes the head of a document that is cut. The sequences of a buffer are then dealt to step
groups of near-equal token counts, heaviest first.

The work is one narrow pass: a task packs its own partition in buffers of a bounded number of ids, so nothing
is shuffled, a lost task is redone alone, and a buffer wastes at most one window. A document longer than a
buffer passes through it window by window.

Cases: a null or empty text is its end id alone; null and repeated document ids are kept as they are, each
row being a document; an empty table gives no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: Context sizes, powers of two, ascending.
TIERS = (256, 512, 1024, 2048)
#: Ids and documents that a buffer holds at most before it is packed.
BUFFER_IDS, BUFFER_DOCS = 1 << 20, 1 << 13
#: Sequences of the largest tier that a step group weighs.
STEP_WINDOWS = 16

Piece = tuple[int, int, int]  # document, start, length


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The smallest tier that holds so many ids."""
    return tiers[bisect_left(tiers, length)]


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows as (tier, pieces in order) for documents of these lengths; every id lies in one piece."""
    top = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), ascending
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= top:
            windows.append((top, [(doc, start, top)]))
            start += top
        if length > start:
            pools[tier_of(length - start, tiers)].append((length - start, doc, start))
    for pool in pools.values():
        pool.sort()
    for at in range(len(tiers) - 1, -1, -1):
        tier, pool, lower = tiers[at], pools[tiers[at]], tiers[:at]
        while pool:
            length, doc, start = pool.pop()
            pieces, gap = [(doc, start, length)], tier - length
            while gap:
                for t in reversed(lower):  # the largest whole document that fits
                    k = bisect_right(pools[t], (gap, float("inf"), 0))
                    if k:
                        length, doc, start = pools[t].pop(k - 1)
                        break
                else:  # none does: cut the head off the one nearest in size
                    source = next((pools[t] for t in (*lower, tier) if pools[t]), None)
                    if source is None:
                        break
                    length, doc, start = source.pop(0)
                    if length > gap:
                        rest = (length - gap, doc, start + gap)
                        insort(pools[tier_of(rest[0], tiers)], rest)
                        length = gap
                pieces.append((doc, start, length))
                gap -= length
            windows.append((tier, pieces))
    return windows


def step_groups(sizes: list[int], weight: int) -> list[int]:
    """A group for each sequence: heaviest first to the lightest of as many groups as the weight asks for."""
    count = max(1, round(sum(sizes) / weight))
    heap, groups = [(0, g) for g in range(count)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heapq.heappop(heap)
        groups[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return groups


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_windows: int = STEP_WINDOWS) -> DataFrame:
    """One row per piece: the document's id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, tier, sequence_tokens, padded_to and step_group. A sequence is padded to the
    largest tier unless its length is a power of two.
    """
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType),
        *(T.StructField(n, T.LongType()) for n in ("start", "length")),
        T.StructField("ids", T.BinaryType()),
        *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset", "tier", "sequence_tokens", "padded_to", "step_group")),
    ])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        from .tokenization import encoder

        encoded, arrow = encoder(tokenizer_path).encoded, to_arrow_schema(schema)
        base = TaskContext.get().partitionId() << 40
        made = {"sequences": 0, "groups": 0}

        def packed(keys: list, docs: list[bytes]) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in schema]
            windows = pack_lengths([len(d) // 4 for d in docs], tiers)
            sizes = [sum(p[2] for p in pieces) for _, pieces in windows]
            groups = step_groups(sizes, step_windows * tiers[-1])
            for (tier, pieces), size, group in zip(windows, sizes, groups, strict=True):
                padded = size if size & (size - 1) == 0 else tiers[-1]
                offset = 0
                for doc, start, length in pieces:
                    row = (keys[doc], start, length, docs[doc][4 * start : 4 * (start + length)], len(docs[doc]) // 4, base + made["sequences"], offset, tier, size, padded, base + made["groups"] + group)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                    offset += length
                made["sequences"] += 1
            made["groups"] += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        keys, docs, held = [], [], 0
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), end), strict=True):
                docs.append(ids)
                keys.append(key)
                held += len(docs[-1]) // 4
                if held >= BUFFER_IDS or len(docs) >= BUFFER_DOCS:
                    yield packed(keys, docs)
                    keys, docs, held = [], [], 0
        if docs:
            yield packed(keys, docs)

    return df.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(run, schema)

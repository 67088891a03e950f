"""Packing documents' tokens into sequences of a fixed length by best-two-fit."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored
from .tokens import rank_encoder

#: Tokens of a sequence; the id that ends a document; pieces that are packed together.
LENGTH, END, GROUP = 2048, 0, 8192


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = "byte_bpe_50k", folder: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, piece, start, length, crc[, ids]): each row's tokens and an end; of more than length the first piece is what whole ones leave. Stored.

    A null text is empty and is an end alone. Repeated rows are documents of their own.
    """
    names = ["doc", "piece", "start", "length", "crc"] + ["ids"] * with_ids

    def cut(batches):
        encoder = rank_encoder(vocabulary, folder)
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode_to_numpy(t or "", allowed_special="all"), END).astype("<u4")
                start, piece = 0, 0
                while start < len(ids):
                    n = (len(ids) - start) % length or length if start == 0 else length
                    part = ids[start : start + n].tobytes()
                    rows.append((doc, piece, start, n, zlib.crc32(part), part) if with_ids else (doc, piece, start, n, zlib.crc32(part)))
                    start, piece = start + n, piece + 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    kinds = "doc long, piece int, start long, length long, crc long" + ", ids binary" * with_ids
    return stored(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("t")).mapInArrow(cut, kinds), "pieces")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins.

    A bin takes the largest length that fits, again and again. If room is left, its smallest length gives way to two unpacked
    ones whose sum fills the room and its place best. Lengths are counted, so equal ones are one entry; the sets of
    lengths that are left are the bits of a number, so a pair of a given sum is found in a few operations.
    """
    count = np.bincount(lengths, minlength=size + 1).tolist()
    left = sum(1 << n for n in range(1, size + 1) if count[n])
    turned = sum(1 << (size - n) for n in range(1, size + 1) if count[n])  # bit size - n for length n

    slots: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    bins = 0

    def change(n: int, by: int) -> None:
        nonlocal left, turned
        count[n] += by
        if count[n] == 0 or count[n] == by == 1:
            left ^= 1 << n
            turned ^= 1 << (size - n)

    while left:
        room, held = size, []
        while fits := left & ((2 << room) - 1):
            n = fits.bit_length() - 1
            change(n, -1)
            held.append(n)
            room -= n
        if room:
            least = held[-1]
            for total in range(room + least, least, -1):
                pair = left & (turned >> (size - total)) & ((2 << (total // 2)) - 1)
                if total % 2 == 0 and pair >> (total // 2) & 1 and count[total // 2] < 2:
                    pair ^= 1 << (total // 2)
                if pair:
                    n = pair.bit_length() - 1
                    change(n, -1)
                    change(total - n, -1)
                    change(least, 1)
                    held[-1:] = [total - n, n]
                    break
        at = 0
        for n in held:
            slots[n].append((bins, at))
            at += n
        bins += 1

    order = np.argsort(lengths, kind="stable")
    place = np.array([s for n in range(1, size + 1) for s in slots[n]], np.int64).reshape(-1, 2)
    out = np.empty_like(place)
    out[order] = place
    return out[:, 0], out[:, 1], bins


def packed(found: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """A stored table of pieces and sequence_id and offset.

    Pieces of the full length are sequences by themselves. The others are dealt by a hash of their row's number into groups of
    about the given number, whatever their document, and each group is packed by itself.
    """
    columns = found.columns
    whole = found.filter(F.col("length") == length).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = found.filter(F.col("length") < length)
    groups = max(1, -(-part.count() // group))

    def pack(table: pa.Table) -> pa.Table:
        bins, offsets, _ = best_two_fit(table.column("length").to_numpy(), length)
        ids = (table.column("g").to_numpy() << 32) + bins
        return pa.table([*[table.column(c) for c in columns], pa.array(ids), pa.array(offsets)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {k}" for n, k in found.dtypes) + ", sequence_id long, offset long"
    dealt = part.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # the numbers themselves begin anew at multiples of 2^33
    return whole.union(dealt.groupBy("g").applyInArrow(pack, schema))


def sequences(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(sequence_id, ids, docs): the packed sequences themselves: their ids, and the documents and pieces in order."""
    rows = packed(pieces(docs, length, with_ids=True, **options), length)
    each = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc", "piece", "length", "ids"))).alias("p"))

    def join(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int64) for p in b.column(1).to_pylist()]
            docs_ = [[{"doc": x["doc"], "piece": x["piece"], "offset": x["offset"], "length": x["length"]} for x in p] for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(docs_, pa.list_(pa.struct([("doc", pa.int64()), ("piece", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))], ["sequence_id", "ids", "docs"])

    return each.mapInArrow(join, "sequence_id long, ids array<long>, docs array<struct<doc:long,piece:int,offset:long,length:long>>")


def packing_digest(docs: DataFrame) -> DataFrame:
    rows = packed(pieces(docs))
    return rows.select(F.col("doc").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(documents(spark, sf_dir).select("doc_id", "text"))

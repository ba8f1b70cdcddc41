"""Best-fit packing with certified bin counts.

Pieces of token sequences go to sequences ("bins") of a fixed capacity.  Pieces
are dealt by hash into partitions of about ``group_pieces``; each is packed by
best-fit decreasing, and a dual-feasible-function bound gives the fewest bins
that its pieces can need.  A partition whose count meets its bound is certified
and stays.  The others keep their full bins and exchange the documents of the
rest: those are dealt anew, in a new mix, and packed again; the repack counts if
it takes fewer bins.  Rounds end when no bins are gained.  Pieces are rows of
numbers throughout; only counts reach the driver.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferna.llm.common import stage

#: Fixed value: how byte-level BPE splits text before merges.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins the lengths can need: the best dual-feasible function of a family.

    For each threshold t up to half the capacity, lengths above capacity - t
    count as whole bins, those below t as nothing, the rest as they are.  Any
    such count is a lower bound; t = 0 gives the total length.
    """
    if len(lengths) == 0:
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    total = np.cumsum(count * np.arange(capacity + 1))
    many = np.cumsum(count)
    t = np.arange(0, capacity // 2 + 1)
    above = many[capacity] - many[capacity - t]
    under = np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    middle = total[capacity - t] - under
    # lengths over half the capacity never share a bin; the middle ones fill what is left beside them
    return int(np.max(above + -(-np.maximum(middle, 0) // capacity)))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number for each length, longest first into the fullest bin that takes it.

    Bins are kept by free room (a sorted list of the rooms that occur), so a
    piece costs a search among at most ``capacity`` rooms.
    """
    out = np.empty(len(lengths), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        at = bisect_left(rooms, need)
        if at == len(rooms):
            b, room = bins, capacity
            bins += 1
        else:
            room = rooms[at]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms.pop(at)
        out[i], left = b, room - need
        if left:
            stack = by_room.setdefault(left, [])
            if not stack:
                insort(rooms, left)
            stack.append(b)
    return out


class Encoder:
    """Ids of whole texts under a byte-level BPE file of ``tokenizers``.

    The file's vocabulary is ranked by its merges, so ``tiktoken`` gives the
    same ids several times faster; that is checked on the file, and if it does
    not hold, and for texts with the string of an added token, ``tokenizers``
    itself is used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            return
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in t): n for t, n in model["vocab"].items() if t not in self.added}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        if all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)):
            import tiktoken
            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                 capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every row of ``docs``: its ids and ``end_id``, cut into pieces.

    A document of at most ``capacity`` ids is one piece.  Of longer ones the
    first piece takes what is left over and the others are full.  Null texts
    are empty and give ``end_id`` alone.
    """
    def tokenize(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder.ids(t or ""), np.uint32(end_id)).astype("<u4")
                start = 0
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    rows.append((k, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in cols[2:])], names=[key, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("body"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(tokenize, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def _pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Packs each value of ``grp`` (a bounded number of pieces): adds bin, offset, full (of the bin) and gap (of the group)."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "pid"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        pdf["gap"] = len(filled) - lower_bound(lengths, capacity)
        pdf["bin"], pdf["full"] = bins, filled[bins] == capacity
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        offset = np.empty(len(bins), dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(filled)])[bins[order]]
        offset[order] = ends - lengths[order] - base
        pdf["offset"] = offset
        return pdf[["pid", "length", "round", "grp", "bin", "offset", "full", "gap"]]

    return pieces.groupBy("grp").applyInPandas(
        pack, "pid long, length long, round int, grp long, bin long, offset long, full boolean, gap long")


def pack_pieces(pieces: DataFrame, capacity: int = 1024, group_pieces: int = 20_000, rounds: int = 3) -> DataFrame:
    """``pieces`` (pid long, length long, unique pid) with sequence_id and offset.

    Each round packs the pieces at hand in groups of about ``group_pieces`` and
    settles certified groups (bins equal the bound) and all full bins.  What is
    left is dealt anew for the next round; it is taken as packed anew only if
    that takes fewer bins in all, else the rounds end.
    """
    full_pieces = pieces.where(F.col("length") == capacity)
    open_pieces, settled = pieces.where(F.col("length") < capacity), None
    best, best_bins = None, None
    for r in range(rounds):
        n = open_pieces.count()
        if n == 0:
            break
        groups = max(1, -(-n // group_pieces))
        dealt = open_pieces.select("pid", "length", F.lit(r).alias("round"),
                                   F.pmod(F.xxhash64("pid", F.lit(r)), F.lit(groups)).alias("grp"))
        packed = stage(_pack(dealt, capacity), f"pack-{r}")
        bins = packed.groupBy("grp").agg(F.countDistinct("bin").alias("n"), F.max("gap").alias("gap"))
        total = bins.agg(F.sum("n")).first()[0]
        if best is not None and total >= best_bins:
            break
        if best is not None:
            settled = best.where("settled") if settled is None else settled.unionByName(best.where("settled"))
        best = packed.withColumn("settled", F.col("full") | (F.col("gap") == 0))
        left = best.where("not settled")
        best_bins = left.select("grp", "bin").distinct().count()
        open_pieces = left.select("pid", "length")
        if best_bins <= 1 or groups == 1:
            break
    parts = [full_pieces.select("pid", F.lit(-1).alias("round"), F.lit(0).cast("long").alias("grp"), F.col("pid").alias("bin"),
                                F.lit(0).cast("long").alias("offset"))]
    for t in (settled, best):
        if t is not None:
            parts.append(t.select("pid", "round", "grp", "bin", "offset"))
    out = parts[0]
    for t in parts[1:]:
        out = out.unionByName(t)
    # distinct numbers of sequences: the round, the group and the bin within it
    return out.select("pid", F.xxhash64("round", "grp", "bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 1024,
                   end_id: int = 2, group_pieces: int = 20_000, rounds: int = 3) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row and its place.

    Sequences hold at most ``capacity`` ids, gapless from offset 0.  Equal rows
    are packed each; null texts are empty; null keys are kept; no rows: no
    sequences.
    """
    pieces = stage(token_pieces(docs, tokenizer, key, text, capacity, end_id)
                   .withColumn("pid", F.monotonically_increasing_id()), "pack-pieces")
    places = pack_pieces(pieces.select("pid", "length"), capacity, group_pieces, rounds)
    return pieces.join(places, "pid").select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

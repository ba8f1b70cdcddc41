"""Removal of repeated byte strings by prefix-free parsing.

Every start of a ``length``-byte string in a document owes itself to a trigger:
the place of the least rolling hash in the ``window`` bytes from that start on.
Neighbouring starts with the same trigger form a phrase: the bytes from its first
start to ``length`` bytes after its last.  A start's trigger is a function of the
string alone, so equal strings sit at the same distance before equal triggers,
whatever lies around them.  That is what makes the parse prefix-free: strings
can be equal only inside phrases that share the bytes after the trigger.

The phrases are sorted (shuffled) by those bytes into classes, the order of the
parse; equal phrases of a class are one entry of the dictionary.

- A class with one phrase has no repeated string.
- A phrase that occurs twice repeats all its strings: found by counting, and no
  string of it is ever looked at.
- What is left are dictionary entries that occur once and share a class with
  others: the edges of repeats.  Their strings are sorted class by class, in
  tasks; neighbours with equal strings are repeats.

The corpus order is needed up to ties of ``length`` bytes only, so strings are
ordered by class, then by a 64-bit hash of their bytes, and not by letters.  What
travels is one row of numbers for about each 80 bytes, and the bytes of the
entries left, never the strings of all places.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferna.llm.common import stage
from inferna.llm.shingles import mix

TABLE = np.random.default_rng(1723).integers(1, 2**63, 256, dtype=np.uint64)
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SEGMENT = 1 << 20
PARCEL = 1 << 17
#: Entries of a class up to which one task sorts it; larger classes are counted string by string in a shuffle.
CLASS_ENTRIES = 20_000


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of neighbouring runs of bytes from the hashes of both."""
    z = x * ONE
    z += y
    z ^= z >> np.uint64(32)
    z *= TWO
    return z


class Hashes:
    """Hash of the ``n`` bytes from every place, for the lengths asked, by doubling."""

    def __init__(self, data: np.ndarray):
        self.level = {1: TABLE[data]}

    def power(self, k: int) -> np.ndarray:
        if k not in self.level:
            half = self.power(k // 2)
            self.level[k] = _join(half[:len(half) - k // 2], half[k // 2:])
        return self.level[k]

    def of(self, n: int) -> np.ndarray:
        k = 1 << (n.bit_length() - 1)
        h = self.power(k)
        return h if n == k else _join(h[:len(h) - (n - k)], h[n - k:])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    k = 1
    while k * 2 <= width:
        x = np.minimum(x[:len(x) - k], x[k:])
        k *= 2
    return x if k == width else np.minimum(x[:len(x) - (width - k)], x[width - k:])


def parse(data: np.ndarray, starts: np.ndarray, length: int, window: int):
    """Phrases over the given string starts (rising places in ``data``): first and last start, class, content."""
    h = Hashes(data)
    grams = h.of(8)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    trigger = (_least(packed, window)[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.ones(len(starts), bool)
    head[1:] = (np.diff(trigger) != 0) | (np.diff(starts) != 1)
    at = np.flatnonzero(head)
    first, last, trig = starts[at], starts[np.append(at[1:], len(starts)) - 1], trigger[at]
    whole = h.of(length)
    content = mix(_join(whole[first], mix(whole[last])) + (last - first).astype(np.uint64) * ONE + (trig - first).astype(np.uint64) * TWO)
    return first, last, h.of(length - window)[trig], content


def _pieces(bodies: list[bytes], length: int):
    """Joined bytes of some documents at a time: (bytes, string starts, text of each start, its place there).

    A long document comes in segments that overlap by the length of a string.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        offset = np.concatenate([[0], np.cumsum([len(b) for _, _, b in held])])
        starts = [np.arange(o, o + len(b) - length + 1) for o, (_, _, b) in zip(offset, held)]
        many = [len(s) for s in starts]
        shift = np.array([at for _, at, _ in held]) - offset[:-1]
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        return data, np.concatenate(starts), np.repeat([d for d, _, _ in held], many), np.repeat(shift, many)

    for d, body in enumerate(bodies):
        for at in range(0, max(0, len(body) - length + 1), SEGMENT):
            held.append((d, at, body[at:at + SEGMENT + length - 1]))
            size += len(held[-1][2])
            if size >= PARCEL:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _ranges(hit: np.ndarray, of: np.ndarray, at: np.ndarray):
    """Runs of neighbouring hits: (row, first, last)."""
    i = np.flatnonzero(hit)
    if len(i) == 0:
        return i, i, i
    head = np.ones(len(i), bool)
    head[1:] = (np.diff(i) != 1) | (np.diff(of[i]) != 0)
    s = np.flatnonzero(head)
    e = np.append(s[1:], len(i)) - 1
    return of[i[s]], at[i[s]], at[i[e]]


def phrases(rows: DataFrame, length: int, window: int) -> DataFrame:
    """(k, first, last, cls, content) of every phrase of every row (k, body)."""
    def run(batches):
        for b in batches:
            keys = b.column("k").to_numpy(zero_copy_only=False)
            for data, starts, text, shift in _pieces([(t or "").encode() for t in b.column("body").to_pylist()], length):
                first, last, cls, content = parse(data, starts, length, window)
                i = np.searchsorted(starts, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[text[i]]), pa.array((first + shift[i]).astype(np.int32)), pa.array((last + shift[i]).astype(np.int32)),
                     pa.array(cls.view(np.int64)), pa.array(content.view(np.int64))], names=["k", "first", "last", "cls", "content"])

    return rows.mapInArrow(run, "k long, first int, last int, cls long, content long")


def _strings(bodies: list[bytes], cls: np.ndarray, length: int):
    """(key of class and string, entry, place in it) of every string of the entries."""
    many = np.array([len(b) - length + 1 for b in bodies])
    offset = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    entry = np.repeat(np.arange(len(bodies)), many)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
    whole = Hashes(data).of(length)[offset[entry] + place]
    return mix(whole ^ mix(cls.view(np.uint64))[entry]), entry, place


def _repeated(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return hit


def entry_bytes(rows: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """``entries`` (k, first, last, cls, once, large) with their bytes; a document's places travel as one list."""
    of = entries.groupBy("k").agg(F.collect_list(F.struct("first", "last", "cls", "once", "large")).alias("places"))

    def cut(batches):
        for b in batches:
            for k, body, p in zip(*(b.column(c).to_pylist() for c in ("k", "body", "places"))):
                body = (body or "").encode()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(p), pa.int64()), pa.array([x["first"] for x in p], pa.int32()),
                     pa.array([x["cls"] for x in p], pa.int64()), pa.array([x["once"] for x in p], pa.bool_()),
                     pa.array([x["large"] for x in p], pa.bool_()),
                     pa.array([body[x["first"]:x["last"] + length] for x in p], pa.binary())],
                    names=["k", "first", "cls", "once", "large", "bytes"])

    return rows.join(of.hint("merge"), "k").select("k", "body", "places").mapInArrow(
        cut, "k long, first int, cls long, once boolean, large boolean, bytes binary")


def sort_classes(cuts: DataFrame, length: int) -> DataFrame:
    """(k, first, last) from whole classes: rows sorted by class, a task's batches cut between classes."""
    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cls = t.column("cls").to_numpy()
            end = int(np.flatnonzero(np.diff(cls, prepend=cls[0] ^ 1))[-1])  # where the last class begins
            held = t.slice(end)
            if end:
                yield from solve(t.slice(0, end))
        if held is not None and held.num_rows:
            yield from solve(held)

    def solve(t):
        cls, bodies = t.column("cls").to_numpy(), t.column("bytes").to_pylist()
        k, first, once = (t.column(c).to_numpy() for c in ("k", "first", "once"))
        stops = np.flatnonzero(np.diff(cls, append=cls[-1] ^ 1)) + 1
        s = size = 0
        for e_before, e in zip(np.append(0, stops[:-1]), stops):  # parcels of whole classes
            size += sum(map(len, bodies[e_before:e]))
            if size >= PARCEL * 2 or e == len(cls):
                key, entry, place = _strings(bodies[s:e], cls[s:e], length)
                row, a, z = _ranges(_repeated(key) & once[s:e][entry], entry, place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[s:e][row], pa.int64()), pa.array((first[s:e][row] + a).astype(np.int32)),
                     pa.array((first[s:e][row] + z).astype(np.int32))], names=["k", "first", "last"])
                s, size = e, 0

    return cuts.where("not large").repartition("cls").sortWithinPartitions("cls").mapInArrow(run, "k long, first int, last int")


def count_strings(cuts: DataFrame, length: int) -> DataFrame:
    """(k, first, last) for classes too large for a task: every string is a row, counted by key."""
    def run(batches):
        for b in batches:
            key, entry, place = _strings(b.column("bytes").to_pylist(), b.column("cls").to_numpy(), length)
            k, first, once = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "first", "once"))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(k[entry]), pa.array((first[entry] + place).astype(np.int32)),
                                              pa.array(once[entry])], names=["key", "k", "at", "once"])

    every = stage(cuts.where("large").mapInArrow(run, "key long, k long, at int, once boolean"), "pfp-strings")
    twice = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return every.where("once").join(twice, "key", "left_semi").select("k", F.col("at").alias("first"), F.col("at").alias("last"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, window: int = 160) -> DataFrame:
    """(key, kept binary, n_bytes, n_removed, n_spans) for every row of ``docs``.

    Removes each byte covered by a ``length``-byte string that also starts
    anywhere else in the table, the same row included, judged on the input; no
    string crosses documents.  Null texts are empty; shorter texts stay whole;
    equal rows repeat each other wholly (if long enough); null keys are kept.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"))
    rows = rows.withColumn("k", F.xxhash64("id", F.col("id").isNull(), "body", F.col("body").isNull()))
    kind = rows.schema["id"].dataType.simpleString()
    found = stage(phrases(rows.select("k", "body"), length, window), "pfp-phrases")
    classes = found.groupBy("cls").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1")
    # a table of its own: a join straight from an aggregation would not be split for a hot class
    classes = stage(classes.select("cls", (F.col("lo") != F.col("hi")).alias("mixed")), "pfp-classes")
    shared = stage(found.join(classes, "cls"), "pfp-shared")
    entries = shared.where("mixed").groupBy("cls", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("k", "first", "last")).alias("w"))
    entries = stage(entries.select("w.k", "w.first", "w.last", "cls", "content", (F.col("n") == 1).alias("once")), "pfp-entries")
    width = entries.groupBy("cls").agg(F.count("*").alias("n"), F.max(F.col("once")).alias("any"))
    large = width.where(F.col("n") > CLASS_ENTRIES).select("cls", F.lit(True).alias("big"))
    any_large = not large.isEmpty()
    # classes all of whose entries occur twice are settled
    sought = entries.join(width.where("any").select("cls", (F.col("n") > CLASS_ENTRIES).alias("large")), "cls")
    cuts = entry_bytes(rows.select("k", "body"), sought, length)
    if any_large:
        cuts = stage(cuts, "pfp-cuts")
    hits = sort_classes(cuts, length)
    if any_large:
        hits = hits.unionByName(count_strings(cuts, length))
    # phrases that occur twice: those of a class of one entry, and the others that are not alone
    lone = entries.where("once").select("cls", "content")
    twice = shared.where("not mixed").select("k", "first", "last").unionByName(
        shared.where("mixed").join(lone, ["cls", "content"], "left_anti").select("k", "first", "last"))
    spans = twice.unionByName(hits).groupBy("k").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def cut(batches):
        for b in batches:
            out = []
            for body, spans in zip(b.column("body").to_pylist(), b.column("spans")):
                body, gone = (body or "").encode(), 0
                if not spans.is_valid:
                    out.append((body, len(body), 0, 0))
                    continue
                first, last = (spans.values.field(c).to_numpy() for c in (0, 1))
                order = np.argsort(first, kind="stable")
                reach = np.maximum.accumulate(last[order].astype(np.int64) + length)
                head = np.append(True, first[order][1:] > reach[:-1])
                a = first[order][head].tolist()
                z = reach[np.append(np.flatnonzero(head)[1:] - 1, len(reach) - 1)].tolist()
                kept = b"".join(body[x:y] for x, y in zip([0, *z], [*a, len(body)]))
                out.append((kept, len(body), len(body) - len(kept), len(a)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                                             names=[key, "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.join(spans.hint("merge"), "k", "left").select("id", "body", "spans").mapInArrow(
        cut, f"`{key}` {kind}, kept binary, n_bytes long, n_removed long, n_spans long")

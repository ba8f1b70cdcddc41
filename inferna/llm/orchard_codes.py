"""Vector codes from codebooks of whole numbers, the nearest entry found by Orchard search.

Every entry of a codebook has a list of all entries by distance from it.  A
part of a vector starts at some entry and goes down that entry's list; as soon as
an entry is nearer it jumps to that entry's list; entries seen before are skipped;
beyond twice the current distance no entry can be nearer or tie, so it stops
there.  A batch of vectors walks its lists in step, a few entries at a time.

Codebooks have a fixed size and are all that leaves the tasks: each round the
tasks send the sums of their parts by entry, as limbs of 32 bits so that no sum
overflows, and Spark adds them up.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferna.llm.common import narrowed, stage

#: List entries looked at in one step, vectors that walk together, largest error that a row can state.
STEP, TOGETHER, LARGEST = 8, 4096, 2**63 - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) of finite doubles, exactly: 64-bit numbers where squares of differences fit, else Python's."""
    if np.abs(x).max(initial=0.0) * scale < math.sqrt(2.0**58 / max(1, x.shape[-1])):
        return np.floor(x * scale).astype(np.int64)
    low = np.floor(x)
    return np.array([[int(a) * scale + int(b) for a, b in zip(r, s)] for r, s in zip(low, np.floor((x - low) * scale))], dtype=object).reshape(x.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


class Codebook:
    """Entries of one part with their lists: ``order[i]`` are the entries by distance from i (ties to the lower), ``gap`` those squared distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squared(entries[:, None], entries[None])
        self.order = np.argsort(between, axis=1, kind="stable")
        self.gap = np.take_along_axis(between, self.order, axis=1)
        total = entries.sum(axis=1)
        self.by_total = np.argsort(total, kind="stable")
        self.totals = total[self.by_total]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each row, ties to the lower entry."""
        n, m = len(x), len(self.entries)
        at = self.by_total[np.minimum(np.searchsorted(self.totals, x.sum(axis=1)), m - 1)]
        best = squared(x, self.entries[at])
        seen = np.zeros((n, m), bool)
        seen[np.arange(n), at] = True
        place, walking = np.zeros(n, np.int64), np.arange(n)
        while len(walking):
            now, reach = at[walking], best[walking]
            span = place[walking, None] + np.arange(STEP)
            inside = span < m
            span = np.minimum(span, m - 1)
            inside &= self.gap[now[:, None], span] <= 4 * reach[:, None]
            entry = self.order[now[:, None], span]
            fresh = inside & ~seen[walking[:, None], entry]
            row, col = np.nonzero(fresh)
            who, what = walking[row], entry[row, col]
            seen[who, what] = True
            far = squared(x[who], self.entries[what])
            # the best of each walker's entries: last of those sorted from far to near
            turn = np.lexsort((-what, -far if far.dtype != object else np.unique(-far, return_inverse=True)[1], row))
            last = turn[np.flatnonzero(np.diff(row[turn], append=-1))]
            who, what, far = who[last], what[last], far[last]
            better = ((far < best[who]) | ((far == best[who]) & (what < at[who]))).astype(bool)
            place[walking] += STEP
            at[who[better]], best[who[better]], place[who[better]] = what[better], far[better], 0
            # who has jumped goes on; the others do while their list has entries within reach
            on = inside[:, -1] & (place[walking] < m)
            on[np.isin(walking, who[better])] = True
            walking = walking[on]
        return at, best


def cuts(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


def assigned(batch, codebooks: list[Codebook], scale: int):
    """Blocks of (whole-number vectors, entry by part, distance by part, first row) of an Arrow batch with column ``vec``."""
    length = sum(c.entries.shape[1] for c in codebooks)
    edge = cuts(length, len(codebooks))
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    for s in range(0, len(flat), TOGETHER):
        x = whole(flat[s:s + TOGETHER], scale)
        found = [c.nearest(x[:, a:b].astype(c.entries.dtype) if c.entries.dtype == object else x[:, a:b]) for c, a, b in zip(codebooks, edge, edge[1:])]
        yield x, [f[0] for f in found], [f[1] for f in found], s


def sums(batches, codebooks: list[Codebook], scale: int):
    """Rows (part, entry, place, limb, value) of a task's sums; place -1 holds counts."""
    total: dict[tuple[int, int], list] = {}
    edge = cuts(sum(c.entries.shape[1] for c in codebooks), len(codebooks))
    for batch in batches:
        for x, entries, _, _ in assigned(batch, codebooks, scale):
            for p, at in enumerate(entries):
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                part = np.add.reduceat(x[order, edge[p]:edge[p + 1]], first, axis=0)
                for e, v, n in zip(at[order][first].tolist(), part.tolist(), np.diff(np.append(first, len(at))).tolist()):
                    old = total.get((p, e))
                    new = [n, *v]
                    total[p, e] = new if old is None else [a + b for a, b in zip(old, new)]
    rows: list[tuple] = []
    for (p, e), values in total.items():
        for i, v in enumerate(values):
            limb, sign, v = 0, -1 if v < 0 else 1, abs(v)
            while v:
                rows.append((p, e, i - 1, limb, sign * (v & 0xFFFFFFFF)))
                v, limb = v >> 32, limb + 1
    names = ["part", "entry", "place", "limb", "value"]
    cols = list(zip(*rows)) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def refined(vectors: DataFrame, codebooks: list[Codebook], scale: int) -> list[Codebook]:
    """Codebooks whose entries are the floored means of the parts nearest to them; unused entries stay."""
    schema = "part long, entry long, place long, limb long, value long"
    added = vectors.select("vec").mapInArrow(partial(sums, codebooks=codebooks, scale=scale), schema) \
        .groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    total: dict[tuple[int, int, int], int] = {}
    for r in added.collect():  # at most parts x entries x places numbers, whatever the input
        k = r.part, r.entry, r.place
        total[k] = total.get(k, 0) + (r.value << 32 * r.limb)
    out = []
    for p, book in enumerate(codebooks):
        entries = [[total.get((p, e, i), 0) // total[p, e, -1] for i in range(len(row))] if (p, e, -1) in total else row for e, row in enumerate(book.entries.tolist())]
        out.append(Codebook(np.array(entries, dtype=book.entries.dtype).reshape(book.entries.shape)))
    return out


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256,
             rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every kept row of ``table``.

    Rows whose vector is null, empty or holds null or non-finite components are
    dropped, and so are those of another length than the vector of the least key; parts are
    as equal as the length allows.  The first entries are the vectors of the
    ``entries`` least distinct keys (of rows with a common key that with the least
    vector; fewer entries if there are fewer keys); null keys get a code but no
    entry, and without any key there are no rows.  Repeated rows stay.  Errors
    beyond 64 bits are stated as the largest number.  Extra columns play no part.
    """
    v = F.col("vec")
    clean = narrowed(table, [key, vector, label]).select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec")) \
        .where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = clean.where("id is not null").orderBy("id").select("id", "vec").limit(1).collect()
    kind = table.schema[key].dataType.simpleString()
    empty = f"{key} {kind}, code string, error long, label_error long, codebooks_sha256 string"
    if not first:
        return table.sparkSession.createDataFrame([], empty)
    kept = stage(clean.where(F.size(v) == len(first[0].vec)), "orchard-vectors")
    start = kept.where("id is not null").groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").limit(entries).collect()
    x = whole(np.array([r.vec for r in start], dtype=np.float64), scale)
    edge = cuts(x.shape[1], parts)
    # whether a vector anywhere needs Python's numbers
    if kept.where(F.array_max(F.transform("vec", F.abs)) * scale >= math.sqrt(2.0**58 / x.shape[1])).limit(1).count():
        x = x.astype(object)
    books = [Codebook(x[:, a:b]) for a, b in zip(edge, edge[1:])]
    for _ in range(rounds):
        books = refined(kept, books, scale)
    digest = hashlib.sha256(",".join(str(i) for b in books for row in b.entries.tolist() for i in row).encode()).hexdigest()
    digits = max(2, len(f"{len(start) - 1:x}"))

    def code(batches):
        for b in batches:
            codes, errors = [], []
            for _, at, far, _ in assigned(b, books, scale):
                codes += ["".join(f"{e:0{digits}x}" for e in row) for row in zip(*(a.tolist() for a in at))]
                errors += [min(sum(row), LARGEST) for row in zip(*(f.tolist() for f in far))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    of = table.schema[label].dataType.simpleString()
    coded = stage(kept.mapInArrow(code, f"id {kind}, label {of}, code string, error long"), "orchard-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    of_label = stage(coded.groupBy(F.col("label").alias("l")).agg(total.alias("label_error")), "orchard-labels")
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("l"))).select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

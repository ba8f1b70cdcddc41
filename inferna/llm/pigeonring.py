"""SimHash near duplicates by pigeonring filtering.

A fingerprint's 64 bits lie on a ring of ``segments`` segments.  If two
fingerprints differ in at most ``distance`` bits, then from some segment on every
chain of l segments differs in at most l x distance / segments bits.  So the
first segment of such a chain is equal and, with the budget b of ``chain``
segments, so is one of b + 1 parts into which the chain's other bits are cut: that
is the key under which fingerprints meet.  Of those that meet, the budgets of the
longer chains weed out most before all bits are compared.

Equal fingerprints are one entry.  A bucket's members are compared in one task,
which returns links that keep them connected, not all pairs.  Fingerprints of
buckets with more than ``crowd`` members do not meet there: each names all
values within ``distance / 2`` bits of itself, and two are near exactly if they
name a common one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferna.llm.common import bounded_broadcast, stage
from inferna.llm.near import components

#: Shingles whose bits are unpacked at once, and the size up to which all pairs of a bucket are tested in step with other buckets.
BLOCK, SMALL = 1 << 15, 32


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """Bits set in over half the XXH64 hashes of the word shingles, as a signed 64-bit number; 0 without words."""
    word = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lowered, and white space is ASCII's
    if not word:
        return 0
    data = b" ".join(word)
    end = np.cumsum([len(w) + 1 for w in word]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(word) - words + 1)
    lo, hi = start[:n].tolist(), end[min(words, len(word)) - 1:].tolist()
    total, hashed = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        h = np.array([hashed(data[s:e], seed) for s, e in zip(lo[i:i + BLOCK], hi[i:i + BLOCK])], dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def ring(distance: int, segments: int, chain: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """(masks of the keys, for each the (mask, budget) of the chains that begin at its segment, from two segments to all)."""
    if distance >= segments or not 1 <= chain <= segments:
        raise ValueError("a ring needs more segments than differing bits, and a chain at most all of them")
    edge = [64 * i // segments for i in range(segments + 1)]
    keys, chains = [], []
    for first in range(segments):
        order = [(first + i) % segments for i in range(segments)]
        bits = [list(range(edge[s], edge[s + 1])) for s in order]
        after = [b for part in bits[1:chain] for b in part]
        parts = chain * distance // segments + 1 if after else 1
        for p in range(parts):
            equal = bits[0] + after[len(after) * p // parts:len(after) * (p + 1) // parts]
            keys.append(sum(1 << b for b in equal))
            chains.append([(sum(1 << b for part in bits[:n] for b in part), n * distance // segments) for n in range(2, segments + 1)])
    return keys, chains


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(slot: np.ndarray, bits: np.ndarray, value: np.ndarray, chains: list) -> tuple[list, list]:
    """Links (a, b) that connect the near members of each bucket; rows of a bucket lie together."""
    new = np.ones(len(slot), bool)
    new[1:] = (slot[1:] != slot[:-1]) | (bits[1:] != bits[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(slot)))
    left, right = [], []

    def near(x: np.ndarray, of: int) -> np.ndarray:
        alive = np.arange(len(x))
        for mask, budget in chains[of]:
            alive = alive[np.bitwise_count(x[alive] & np.uint64(mask)) <= budget]
        return alive

    few = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    group = np.repeat(np.arange(len(start)), size)
    for step in range(1, SMALL):
        few = few[few + step < len(slot)]
        few = few[group[few] == group[few + step]]
        if not len(few):
            break
        for of in np.unique(slot[few]):
            at = few[slot[few] == of]
            hit = at[near(value[at] ^ value[at + step], of)]
            left.append(value[hit])
            right.append(value[hit + step])
    for s, n in zip(start[size > SMALL], size[size > SMALL]):
        # a search from member to member: each looks once among those not yet reached
        rest = value[s:s + n]
        while len(rest):
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                x = reached.pop()
                hit = near(rest ^ x, slot[s])
                if len(hit):
                    left.append(np.full(len(hit), x, np.uint64))
                    right.append(rest[hit])
                    reached.extend(rest[hit])
                    rest = np.delete(rest, hit)
    return left, right


def links(values: DataFrame, distance: int = 4, segments: int = 5, chain: int = 3, crowd: int = 4096) -> DataFrame:
    """(a, b): links between the distinct 64-bit numbers ``values`` (value) that join all that differ in at most ``distance`` bits."""
    keys, chains = ring(distance, segments, chain)
    v = F.col("value")
    met = values.select(v, F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), v.bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(keys)])).alias("k")) \
        .select("value", "k.slot", "k.bits")
    crowded = stage(met.groupBy("slot", "bits").agg(F.count("*").alias("n")).where(F.col("n") > crowd), "ring-crowded")
    n_crowded = crowded.count()
    here = met.join(bounded_broadcast(crowded, n_crowded, 24), ["slot", "bits"], "left_anti") if n_crowded else met

    def meet(batches):
        held = None
        for b in batches:
            now = [b.column("slot").to_numpy(), b.column("bits").to_numpy(), b.column("value").to_numpy().view(np.uint64)]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now)]
            # the last bucket may go on in the next batch
            whole = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = whole[-1] + 1 if len(whole) else 0
            held = [x[cut:] for x in now]
            yield from linked(*(x[:cut] for x in now))
        if held is not None:
            yield from linked(*held)

    def linked(slot, bits, value):
        if len(slot):
            a, b = bucket_links(slot, bits, value, chains)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    found = here.repartition("slot", "bits").sortWithinPartitions("slot", "bits", "value").mapInArrow(meet, "a long, b long")
    if not n_crowded:
        return found
    # values within half the distance: all sets of so many bits
    half = [[signed(sum(1 << b for b in c)) for c in combinations(range(64), r)] for r in range((distance + 1) // 2 + 1)]
    near, far = [m for r in half[:distance // 2 + 1] for m in r], [m for r in half for m in r]
    dense = stage(met.join(bounded_broadcast(crowded, n_crowded, 24), ["slot", "bits"]).select("value").distinct(), "ring-dense")

    def named(masks: list[int], column: str) -> DataFrame:
        flips = np.array(masks, np.int64)  # 2081 at distance 4

        def spread(batches):
            for b in batches:
                value = b.column("value").to_numpy()
                for s in range(0, len(value), 256):
                    x = value[s:s + 256]
                    yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ flips).ravel()), pa.array(np.repeat(x, len(flips)))], names=["at", column])
        return dense.mapInArrow(spread, f"at long, {column} long")

    if distance % 2 == 0:
        hub = stage(named(near, "b").groupBy("at").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("at", "a"), "ring-hubs")
        more = named(near, "b").join(hub, "at").where("a <> b").select("a", "b").distinct()
    else:
        # at an odd distance one side goes a bit further: the value of least distance to the hub stands for its side
        hub = stage(named(near, "a").groupBy("at").agg(F.min("a").alias("a")), "ring-hubs")
        more = named(far, "b").join(hub, "at").where("a <> b").select("a", "b").distinct()
    return found.unionByName(more)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4,
                    segments: int = 5, chain: int = 3, crowd: int = 4096) -> DataFrame:
    """(key, fingerprint, component) for every row of ``docs``.

    ``fingerprint`` is a signed 64-bit number; ``component`` the least key
    among all rows whose fingerprints are reached by links of at most ``distance``
    differing bits.  Null, empty and wordless texts have fingerprint 0, linked like
    any other; texts with fewer than ``words`` words are one shingle; texts of
    any length are hashed whole, block by block.  Null keys get a row and never name
    a component unless it has no other key; repeated rows stay; extra columns
    play no part.
    """
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([fingerprint(t, words) for t in b.column("body").to_pylist()], pa.int64())], names=["id", "value"])

    rows = stage(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body")).mapInArrow(sign, f"id {kind}, value long"), "ring-prints")
    entries = stage(rows.groupBy("value").agg(F.min("id").alias("least")), "ring-entries")
    found = stage(links(entries.select("value"), distance, segments, chain, crowd).distinct(), "ring-links")
    label = components(entries.select(F.col("value").alias("id")), found, found.count()).select(F.col("id").alias("value"), "label")
    labelled = stage(entries.join(label, "value"), "ring-labels")
    least = stage(labelled.groupBy("label").agg(F.min("least").alias("component")), "ring-least")
    # a table of its own: a join straight from a join would not be split for a hot fingerprint
    component = stage(labelled.join(least, "label").select("value", "component"), "ring-components")
    return rows.join(component, "value").select(F.col("id").alias(key), F.col("value").alias("fingerprint"), "component")

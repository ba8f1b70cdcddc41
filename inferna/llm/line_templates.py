"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its leading
tokens; tokens with digits, ``@`` or ``/`` are fields anywhere.  In leaves that
recur, a line's variable tokens become fields by how often they stand at their place
in the leaf: those of too few texts first, then the least frequent ones step by
step, so that lines that differ there meet in one template.  At least ``min_tokens``
and six tenths of a template's tokens are constant, and no run of fields is longer
than ``width``; a line with more rare tokens than that has no template.  Whole lines
count at any length.  Templates are 64-bit keys; only keys and the tokens of distinct
lines in recurring leaves travel.

A line or template recurs if it lies in at least ``min_docs`` different texts
(equal texts count once, so copies of a document do not condemn its lines), from
``long_tokens`` tokens on in ``long_docs``, since nobody writes a passage twice.
Its lines are dropped from all texts but the one with the least key, which keeps
them: what goes is repetition and, of a template's lines, the few tokens of fields.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferna.llm.common import apart, bounded_broadcast, let, restored, stage
from inferna.llm.shingles import BYTE_FACTORS, mix, parcels

FIELD, OTHER = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)


def line_tokens(texts: list[str]):
    """(text, line in it, first token, tokens) of every line with tokens, then (hash, hash with fields masked, factor by place) of every token."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    size = np.array([len(r) + 1 for r in raw])
    inside = data > 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start) == 0:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 3
    begun = np.zeros(len(data), np.int64)
    begun[start] = start
    place = np.arange(len(data)) - np.maximum.accumulate(begun)
    part = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * BYTE_FACTORS[place & 4095], np.uint64(0))
    exact = mix(np.add.reduceat(part, start) + (end - start).astype(np.uint64))
    odd = ((data >= 48) & (data <= 57)) | (data == 64) | (data == 47)
    token = np.where(np.logical_or.reduceat(odd & inside, start), FIELD, exact)
    line = np.cumsum(data == 10)[start]  # number of the line among all lines of the texts
    first = np.flatnonzero(np.diff(line, prepend=-1))  # its first token
    n = np.diff(np.append(first, len(token)))
    text = np.searchsorted(np.cumsum(size), start[first], side="right")
    before = np.concatenate([[0], np.cumsum(data == 10)[np.cumsum(size) - 1]])[:-1]  # lines ahead of each text
    pos = np.arange(len(token)) - np.repeat(first, n)
    return text, line[first] - before[text], first, n, exact, token, mix(pos.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


def line_keys(texts: list[str], leading: int, long_tokens: int):
    """(text number, line number, key of the line, key of its leaf) arrays; keys of lines of ``long_tokens`` are odd."""
    text, number, first, n, exact, token, factor = line_tokens(texts)
    if len(first) == 0:
        return text, number, first, first
    count, long = n.astype(np.uint64) * FIELD, (n >= long_tokens).astype(np.uint64)
    whole = mix(np.add.reduceat(exact * factor, first) + count + OTHER)
    lead = np.where(np.arange(len(token)) - np.repeat(first, n) < leading, token * factor, np.uint64(0))
    leaf = mix(np.add.reduceat(lead, first) + count)
    return text, number, *((k & ~np.uint64(1) | long).view(np.int64) for k in (whole, leaf))


def fields(often: list[int], masked: list[bool], total: int, need: int, width: int, most: int):
    """The sets of places that templates of a line generalise beyond ``masked`` ones, each within the next: first the places whose
    token occurs there in fewer than ``need`` texts of the leaf, then the least frequent tokens that are left, while some other
    line of the leaf differs there, at most ``most`` places are fields and no run of fields is longer than ``width``."""
    n = len(often)
    order = sorted((i for i in range(n) if not masked[i] and often[i] < total), key=often.__getitem__)
    field, count, at = list(masked), sum(masked), 0
    bar = need
    while True:
        added = []
        while at < len(order) and often[order[at]] < bar:
            field[order[at]] = True
            added.append(order[at])
            at += 1
        count += len(added)
        if count > most or any(all(field[i - width:i + 1]) for a in (added or range(n)) for i in range(max(width, a), min(n, a + width + 1))):
            return
        yield added
        if at == len(order):
            return
        bar = often[order[at]] + 1


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10, leading: int = 2,
                   width: int = 3, min_tokens: int = 3, long_tokens: int = 50, long_docs: int = 2) -> DataFrame:
    """``docs`` with recurring lines cut from ``text`` and two new columns, _n_lines and _n_dropped.

    Lines part at line feeds; texts without a dropped line stay byte for byte.
    Every row stays, even if no line is left (its text is then empty); equal rows
    are treated alike; null texts stay null with 0 lines, empty ones have one
    line; rows with a null key count as texts but are never the first.  A column
    of ``docs`` named as a new one gives way to it; other columns stay, whatever
    their names.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body")).where("body is not null") \
        .select("id", F.xxhash64("body").alias("entry"), "body")
    kind = docs.schema[key].dataType.simpleString()

    def keys(batches):
        for b in batches:
            texts = b.column("body").to_pylist()
            out: list[list] = [[[] for _ in texts] for _ in range(3)]
            for s, e in parcels(texts):
                t, *found = line_keys(texts[s:e], leading, long_tokens)
                cut = np.searchsorted(t, np.arange(e - s + 1))
                for d in range(e - s):
                    for o, f in zip(out, found):
                        o[s + d] = f[cut[d]:cut[d + 1]]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("entry"), pa.array(out[0], pa.list_(pa.int32())), *(pa.array(o, pa.list_(pa.int64())) for o in out[1:])],
                                             names=["id", "entry", "at", "of", "leaf"])

    def needed(c: str):
        return F.when(F.col(c).bitwiseAND(F.lit(1)) == 1, long_docs).otherwise(min_docs)

    parsed = rows.mapInArrow(keys, f"id {kind}, entry long, at array<int>, of array<long>, leaf array<long>")
    # equal texts once, with the least key
    once = stage(parsed.groupBy("entry").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("at", "of", "leaf")]), "line-keys")
    spots = (once.select("id", "entry", F.explode_outer(F.arrays_zip("at", "of", "leaf")).alias("s")).where("s is not null")
             .select("id", "entry", "s.at", F.col("s.of").alias("k"), "s.leaf"))
    # whole lines: every one with its texts and a place to read it
    seen = stage(once.select("id", "entry", F.explode_outer(F.array_distinct("of")).alias("k")).where("k is not null")
                 .groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("keeper")).where(F.col("n") >= needed("k")).select("k", "keeper"), "line-recurring")
    leaves = stage(once.select(F.explode_outer(F.array_distinct("leaf")).alias("leaf")).where("leaf is not null")
                   .groupBy("leaf").count().where(F.col("count") >= needed("leaf")).select("leaf"), "line-leaves")
    lines = stage(spots.join(bounded_broadcast(leaves, leaves.count(), 16), "leaf").groupBy("k", "leaf")
                  .agg(F.count("*").alias("n"), F.min(F.struct("entry", "id", "at")).alias("w")), "line-distinct")
    wanted = stage(lines.groupBy(F.col("w.entry").alias("entry"), F.col("w.id").alias("_id"))
                   .agg(F.collect_list(F.struct("w.at", "k", "leaf", "n")).alias("want")), "line-wanted")

    def read(batches):
        for b in batches:
            of, found = [], []
            texts, want = b.column("body").to_pylist(), b.column("want").to_pylist()
            for s, e in parcels(texts):
                t, number, first, n, _, token, _ = line_tokens(texts[s:e])
                at = {(x, y): i for i, (x, y) in enumerate(zip(t.tolist(), number.tolist()))}
                for d in range(s, e):
                    for w in want[d]:
                        i = at[d - s, w["at"]]
                        of.append(w)
                        found.append(token[first[i]:first[i] + n[i]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([w[c] for w in of], pa.int64()) for c in ("k", "leaf", "n")] + [pa.array(found, pa.list_(pa.int64()))],
                                             names=["k", "leaf", "n", "tokens"])

    texts = rows.join(wanted.hint("merge"), (rows["entry"] == wanted["entry"]) & rows["id"].eqNullSafe(wanted["_id"])).select("body", "want")
    tokens = stage(texts.mapInArrow(read, "k long, leaf long, n long, tokens array<long>").dropDuplicates(["k", "leaf"]), "line-tokens")
    # how often a token stands at its place in the leaf; the rare ones are alike, whatever their count, so only the others are kept
    named = F.xxhash64("leaf", "pos", "token").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("leaf").bitwiseAND(F.lit(1)))
    spread = (tokens.select("k", "leaf", "n", F.posexplode_outer("tokens").alias("pos", "token"))
              .where(F.col("token") != int(FIELD.view(np.int64))).select("k", "n", "pos", named.alias("spot")))
    often = stage(spread.groupBy("spot").agg(F.sum("n").alias("often")).where(F.col("often") >= needed("spot")), "line-often")
    total = stage(tokens.groupBy("leaf").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"), "line-totals")
    counts = (spread.select("k", "pos", "spot").join(often, "spot").groupBy("k").agg(F.collect_list(F.struct("pos", "often")).alias("s"))
              .where(F.size("s") >= min_tokens).select("k", F.col("s.pos").alias("place"), F.col("s.often").alias("often")))

    def generalise(batches):
        full = (1 << 64) - 1
        for b in batches:
            ks, ns, out = [], [], []
            size = np.diff(b.column("tokens").offsets.to_numpy())
            toks = b.column("tokens").flatten().to_numpy().view(np.uint64)
            leaf, total = b.column("leaf").to_numpy(), b.column("total").to_numpy()
            need = np.where(leaf & 1 == 1, long_docs, min_docs)
            begin = np.cumsum(size) - size
            often = np.zeros(len(toks), np.int64)
            often[np.repeat(begin, np.diff(b.column("place").offsets.to_numpy())) + b.column("place").flatten().to_numpy()] = b.column("often").flatten().to_numpy()
            masked = toks == FIELD
            most = size - np.maximum(min_tokens, -(-6 * size // 10))
            # lines with too many rare tokens have no template; the rest are few
            rare = np.add.reduceat(masked | (often < np.repeat(need, size)), begin, dtype=np.int64) if len(size) else size
            for i in np.flatnonzero(rare <= most).tolist():
                c = slice(begin[i], begin[i] + size[i])
                factor = mix(np.arange(1, size[i] + 1, dtype=np.uint64)) | np.uint64(1)
                gap = ((toks[c] - FIELD) * factor).tolist()
                key, found = int((toks[c] * factor).sum()) + int(size[i]) * int(FIELD), []
                for places in fields(often[c].tolist(), masked[c].tolist(), int(total[i]), int(need[i]), width, int(most[i])):
                    key -= sum(gap[j] for j in places)
                    found.append(key & full)
                if found:
                    ks.append(b.column("k")[i].as_py())
                    ns.append(b.column("n")[i].as_py())
                    out.append((mix(np.array(found, np.uint64)) & ~np.uint64(1) | np.uint64(leaf[i] & 1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ns, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["k", "n", "of"])

    fits = stage(tokens.join(total, "leaf").join(counts, "k").mapInArrow(generalise, "k long, n long, of array<long>")
                 .select("k", "n", F.explode_outer("of").alias("template")), "line-fits")
    # a template of one line is the whole line
    several = stage(fits.groupBy("template").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
                    .where((F.col("kinds") > 1) & (F.col("n") >= needed("template"))).select("template"), "line-several")
    shared = stage(fits.join(several.hint("merge"), "template").select("k", "template"), "line-shared")
    held = stage(spots.select("id", "entry", "at", "k").join(shared.hint("merge"), "k"), "line-held")
    keepers = stage(held.select("id", "entry", "template").distinct().groupBy("template").agg(F.count("*").alias("n"), F.min("id").alias("keeper"))
                    .where(F.col("n") >= needed("template")).select("template", "keeper"), "line-keepers")
    whole = spots.select("id", "entry", "at", "k").join(bounded_broadcast(seen, seen.count(), 24), "k").where(~F.col("id").eqNullSafe(F.col("keeper")))
    alike = held.join(bounded_broadcast(keepers, keepers.count(), 24), "template").where(~F.col("id").eqNullSafe(F.col("keeper")))
    dropped = (whole.select("entry", "at").unionByName(alike.select("entry", "at"))
               .groupBy("entry").agg(F.collect_set("at").alias("gone")))
    dropped = stage(dropped, "line-dropped")
    body = F.col(f"`{text}`")
    docs, back = apart(docs.drop("_n_lines", "_n_dropped"), ("_entry", "_gone"))
    t = docs.withColumn("_entry", F.xxhash64(body))
    # sorted and merged at every size: the dropped places grow with the corpus
    t = t.join(dropped.withColumnRenamed("entry", "_entry").withColumnRenamed("gone", "_gone").hint("merge"), "_entry", "left")
    left = let(F.split(body, "\n", -1), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n"))
    cols = [F.when(F.col("_gone").isNull() | body.isNull(), body).otherwise(left).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return restored(t.select(
        *cols, F.when(body.isNull(), 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("_n_lines"),
        F.when(F.col("_gone").isNull() | body.isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("_n_dropped")), back)

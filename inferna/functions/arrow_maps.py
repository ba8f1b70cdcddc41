"""Feature maps by column: whole Arrow batches of map<string,double> at a time, in numpy.

Map functions of the engine hash every key several times and box every value;
here the names of a batch are numbered once and all rows are worked on together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a dense block of rows x names.
CELLS = 4_000_000


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each row, the row of each entry, and where it lies in the children; a null row has none."""
    offset = column.offsets.to_numpy().astype(np.int64)
    n = np.diff(offset)
    if column.null_count:
        n = np.where(column.is_valid().to_numpy(zero_copy_only=False), n, 0)
    return n, np.repeat(np.arange(len(n)), n), np.repeat(offset[:-1], n) + within(n)


def within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of ``n`` entries."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def picked(child: pa.Array, at: np.ndarray) -> pa.Array:
    if len(at) and at[-1] - at[0] + 1 == len(at):
        return child.slice(int(at[0]), len(at))
    return child.take(pa.array(at))


def numbers(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False).astype(np.float64)


def dense(column: pa.Array, names: list[str]) -> np.ndarray:
    """Rows x ``names`` (distinct) of a map column; absent and null values are 0."""
    out = np.zeros((len(column), len(names)))
    _, row, at = entries(column)
    code = pc.index_in(picked(column.keys, at), value_set=pa.array(names, pa.string()))
    known = code.is_valid().to_numpy(zero_copy_only=False)
    out[row[known], pc.fill_null(code, 0).to_numpy()[known]] = numbers(picked(column.items, at))[known]
    return out


def as_lists(rows: np.ndarray) -> pa.Array:
    """A dense block as one list of doubles a row."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def sides(p: pa.Array, h: pa.Array, family: str) -> tuple[list[str], list[tuple]]:
    """The names and the three blocks (entries a row, name of each entry, value of each) of a family: premise, hypothesis, difference."""
    (pn, prow, pat), (hn, hrow, hat) = entries(p), entries(h)
    coded = pc.dictionary_encode(pa.concat_arrays([picked(p.keys, pat).cast(pa.string()), picked(h.keys, hat).cast(pa.string())]))
    known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    pcode, hcode = code[:len(pat)], code[len(pat):]
    pval, hval = picked(p.items, pat), picked(h.items, hat)
    pnum, hnum, width = numbers(pval), numbers(hval), max(1, len(known))
    other, alone = np.zeros(len(pat)), np.ones(len(hat), bool)
    step = max(1, CELLS // width)
    for s in range(0, len(p), step):
        a, b = (slice(*np.searchsorted(row, [s, s + step])) for row in (prow, hrow))
        shape = min(step, len(p) - s), width
        value, seen = np.zeros(shape), np.zeros(shape, bool)
        value[hrow[b] - s, hcode[b]] = hnum[b]
        seen[prow[a] - s, pcode[a]] = True
        other[a], alone[b] = value[prow[a] - s, pcode[a]], ~seen[hrow[b] - s, hcode[b]]
    # the premise's names, then those of the hypothesis alone
    extra = np.bincount(hrow[alone], minlength=len(p)).astype(np.int64)
    order = np.argsort(np.concatenate([prow, hrow[alone]]), kind="stable")
    with np.errstate(invalid="ignore"):
        far = np.concatenate([np.abs(pnum - other), np.abs(hnum[alone])])[order]
    names = [f"{side}_{family}_{x}" for side in ("premise", "hypothesis", "diff") for x in known]
    return names, [(pn, pcode, pval), (hn, hcode + len(known), hval), (pn + extra, np.concatenate([pcode, hcode[alone]])[order] + 2 * len(known), pa.array(far))]


def pair_map(pc_: pa.Array, hc: pa.Array, pd: pa.Array, hd: pa.Array) -> pa.Array:
    """One map a row: both sides of both families, then the differences."""
    const, c = sides(pc_, hc, "const")
    dep, d = sides(pd, hd, "dep")
    blocks = [*c[:2], *((n, code + len(const), v) for n, code, v in d[:2]), c[2], (d[2][0], d[2][1] + len(const), d[2][2])]
    total = np.sum([n for n, _, _ in blocks], axis=0).astype(np.int64) if len(pc_) else np.zeros(0, np.int64)
    start = np.cumsum(total) - total
    key, source = np.zeros(total.sum(), np.int64), np.zeros(total.sum(), np.int64)
    before = 0
    for n, code, value in blocks:
        at = np.repeat(start, n) + within(n)
        key[at], source[at] = code, np.arange(len(code)) + before
        start, before = start + n, before + len(code)
    values = pa.concat_arrays([v.cast(pa.float64()) for _, _, v in blocks]).take(pa.array(source))
    offset = np.concatenate([[0], np.cumsum(total)]).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offset, pa.int32()), pa.array([*const, *dep], pa.string()).take(pa.array(key)), values)


def tag_counts(column: pa.Array, missing: str, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(entries of each row, row, and count of each entry's tag; names by code): the distinct tags of each row in order of their first place."""
    n, row, at = entries(column)
    coded = pc.dictionary_encode(pc.fill_null(picked(column.values, at), missing))
    code, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    key, first, count = np.unique(row * max(1, len(known)) + code, return_index=True, return_counts=True)
    order = np.argsort(first, kind="stable")
    rows, codes = np.divmod(key[order], max(1, len(known)))
    return np.bincount(rows, minlength=len(n)).astype(np.int64), codes, count[order].astype(np.float64), [prefix + x for x in known]


def dep_map(ids: pa.Array, heads: pa.Array, pos: pa.Array, rel: pa.Array) -> pa.Array:
    """Tag counts, then the four tree statistics, of each row's edges; a null row has no entries."""
    n, row, at = entries(heads)
    head = pc.fill_null(picked(heads.values, at), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    _, _, iat = entries(ids)
    id_ = pc.fill_null(picked(ids.values, iat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    here, size = np.arange(len(n)), len(n)
    deep = np.zeros(size, np.int64)
    np.maximum.at(deep, row, head)
    linked = (id_ > 0) & (head > 0)
    far = np.abs(id_ - head)
    most, total = np.zeros(size, np.int64), np.bincount(row[linked], weights=far[linked], minlength=size)
    np.maximum.at(most, row[linked], far[linked])
    roots = np.bincount(row[head == 0], minlength=size)
    rest = n - roots
    mean = np.divide(total, rest, out=np.zeros(size), where=rest > 0)
    pn, pcode, pcount, pnames = tag_counts(pos, "UNK_POS", "pos_")
    rn, rcode, rcount, rnames = tag_counts(rel, "UNK_DEP", "deprel_")
    stats = ["dep_tree_depth_proxy", "avg_dep_dist", "max_dep_dist", "root_children_count"]
    kept = here[heads.is_valid().to_numpy(zero_copy_only=False)] if heads.null_count else here
    sn = np.zeros(size, np.int64)
    sn[kept] = len(stats)
    blocks = [(pn, pcode, pcount), (rn, rcode + len(pnames), rcount),
              (sn, np.tile(np.arange(len(stats)), len(kept)) + len(pnames) + len(rnames), np.stack([deep, mean, most, roots], axis=1)[kept].astype(np.float64).ravel())]
    width = pn + rn + sn
    key, value, start = np.zeros(width.sum(), np.int64), np.zeros(width.sum()), np.cumsum(width) - width
    for m, code, v in blocks:
        to = np.repeat(start, m) + within(m)
        key[to], value[to], start = code, v, start + m
    offset = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offset, pa.int32()), pa.array([*pnames, *rnames, *stats], pa.string()).take(pa.array(key)), pa.array(value))


# ---- trees of the rule annotator ------------------------------------------------

TAGS, RELATIONS = ["NUM", "ADP", "DET", "VERB", "NOUN"], ["root", "det", "case", "nummod", "conj", "nsubj", "obj"]
#: What stands before a token: the brackets that open at its place, then those of its leaf.
BEFORE = [place + leaf for place in ("", "(ROOT (S (NP", "(ROOT (S (VP", ") (VP") for leaf in (" (NUM ", " (PP (ADP ", " (DET ", " (VERB ", " (NOUN ")]
AFTER = [")", "))", "))))", ")))))"]


def rule_trees(tokens: pa.Array) -> pa.Array:
    """(constituency; id, pos, head and deprel of each token) of each row's tokens, which are not empty."""
    n, row, at = entries(tokens)
    t = picked(tokens.values, at).cast(pa.string())
    idx, size = within(n) + 1, pc.utf8_length(t).to_numpy().astype(np.int64)
    starts = np.frombuffer(t.buffers()[1], np.int32, len(t) + 1, t.offset * 4)[:-1] if len(t) else np.zeros(0, np.int32)
    letter = np.frombuffer(t.buffers()[2], np.uint8)[starts] if len(t) else np.zeros(0, np.uint8)
    num, adp, det, verb, noun = range(5)
    tag = np.select([(letter >= ord("0")) & (letter <= ord("9")), size <= 2, size == 3, size % 3 == 0], [num, adp, det, verb], noun)
    # the first verb, or else the first token
    root, found = np.ones(len(n), np.int64), np.flatnonzero(tag == verb)
    first = found[np.diff(row[found], prepend=-1) > 0]
    root[row[first]] = idx[first]
    root, last = root[row], idx == n[row]
    at_root, before = idx == root, idx < root
    head = np.select([at_root, ((tag == det) | (tag == adp)) & ~last, before], [0, idx + 1, root], idx - 1)
    rel = np.select([at_root, tag == det, tag == adp, tag == num, tag == verb, before], range(6), 6)
    place = np.select([(idx == 1) & before, idx == 1, at_root], [1, 2, 3], 0)
    pieces = pc.binary_join_element_wise(pa.array(BEFORE).take(pa.array(place * len(TAGS) + tag)), t, pa.array(AFTER).take(pa.array((tag == adp) + 2 * last)), "")
    # the pieces of a row lie one after the other: its tree is where they begin and end
    offset = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    if len(t):
        ends = np.frombuffer(pieces.buffers()[1], np.int32, len(t) + 1, pieces.offset * 4)
        tree = pa.StringArray.from_buffers(len(n), pa.py_buffer(np.ascontiguousarray(ends[offset])), pieces.buffers()[2])
    else:
        tree = pa.array([""] * len(n), pa.string())
    lists = [pa.ListArray.from_arrays(pa.array(offset, pa.int32()), x) for x in (
        pa.array(idx.astype(np.int32)), pa.array(TAGS).take(pa.array(tag)), pa.array(head.astype(np.int32)), pa.array(RELATIONS).take(pa.array(rel)))]
    return pa.StructArray.from_arrays([tree, *lists], ["constituency", "id", "pos", "head", "deprel"])

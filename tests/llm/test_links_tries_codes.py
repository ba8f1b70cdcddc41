"""Fingerprint links, the prefix trie and vector codes against brute force, with their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from inferna.llm import orchard_codes, pigeonring, prefix_trie


# fingerprints

def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [xxhash.xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def plain_components(values, distance=4):
    """{value: least value that links reach}"""
    values, label = sorted(set(values)), {}
    for v in values:
        if v not in label:
            label[v], todo = v, [v]
            while todo:
                x = todo.pop()
                for y in values:
                    if y not in label and (x ^ y).bit_count() <= distance:
                        label[y] = v
                        todo.append(y)
    return label


def test_fingerprints_of_odd_texts():
    r = random.Random(3)
    texts = [None, "", " \n\t", "One", "one two three", "A b C d", "Ä ä  x y\x1cz \x85 end", "x " * 9000,
             " ".join(str(r.random()) for _ in range(40_000))]
    assert [pigeonring.fingerprint(t, 4) & (1 << 64) - 1 for t in texts] == [plain_print(t) for t in texts]


@pytest.mark.parametrize("crowd, distance, segments, chain", [(4096, 4, 5, 3), (6, 4, 5, 3), (6, 3, 4, 2), (4096, 2, 6, 1)])
def test_links_join_all_near_values(spark, crowd, distance, segments, chain):
    r = random.Random(distance)
    centres = [r.getrandbits(64) for _ in range(60)]
    values = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for c in centres for _ in range(r.choice([1, 3, 8]))}
    values |= {centres[0] ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 6))) for _ in range(150)}  # a crowd
    frame = spark.createDataFrame([(pigeonring.signed(v),) for v in values], "value long")
    found = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in pigeonring.links(frame, distance, segments, chain, crowd).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in found)
    near = collections.defaultdict(set)
    for a, b in found:
        near[a].add(b), near[b].add(a)
    label = {}
    for v in sorted(values):
        todo = [v] if v not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = v
                todo += near[x]
    assert label == plain_components(values, distance)


def test_ring_needs_more_segments_than_bits():
    with pytest.raises(ValueError):
        pigeonring.ring(5, 5, 2)


def test_fingerprint_components_of_documents(spark):
    r = random.Random(8)
    base = [r.choices("abcdefgh", k=300) for _ in range(3)]
    texts = [None, "", " ", "one"] + [" ".join(b[:i] + ["zz"] + b[i:]) for b in base for i in range(0, 300, 30)] + ["one", None]
    rows = [(i if i != 3 else None, t, i, "x", "y") for i, t in enumerate(texts)] + [(7, texts[7], 7, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value long, least string, component string")
    prints = [plain_print(t) for _, t, *_ in rows]
    label = plain_components(prints)
    least = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    want = sorted((str(i), pigeonring.signed(p), least.get(label[p])) for (i, *_), p in zip(rows, prints))
    got = pigeonring.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component"]
    assert sorted((str(i), p, c) for i, p, c in got.collect()) == want
    assert pigeonring.near_duplicates(docs.limit(0)).count() == 0


# conversations

def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    first = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    nodes, kids = collections.defaultdict(list), collections.Counter()
    for c, own in first.items():
        h = zlib.crc32(str(c).encode()) % 4
        own = first.get(c - c % 20, [])[:h] + own[h:]
        for d in range(len(own) + 1):
            nodes[tuple(own[:d])].append((c, d == len(own)))
    leaves, saved = collections.Counter(), collections.Counter()
    for p in nodes:
        kids[p[:-1]] += len(p) > 0
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted((min(m)[0], len(p), min(nodes[p[:-1]])[0] if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c, e in sorted(m) if e).encode()).hexdigest()) for p, m in nodes.items())


def talk(seed=5):
    r = random.Random(seed)
    rows = [(c, t if t else None, r.choice(["user", None]), r.choice([None, "", "hi there", "a b\tc", " x y"])) for c in range(90) if c not in (40, 41) for t in range(r.randint(1, 5))]
    rows += [(200 + i, t, "user", f"copy {t}") for i in range(30) for t in range(4)]  # one conversation, often
    rows += [(300, t, "bot", f"turn {t % 7}") for t in range(300)]  # one long conversation
    rows += [(None, 1, "user", "nobody"), (55, 3, "user", "x" * 200_000), (56, 9, "a", "tie"), (56, 9, "a", "tie"), (56, 9, None, "tie")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_nodes, queue", [(100_000, 1 << 16), (40, 3), (1, 2)])
def test_trie_against_plain_paths(spark, shard_nodes, queue):
    rows = talk()
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn long, role string, text string, k1 long, depth long")
    got = prefix_trie.rebuilt_trie(frame, shard_nodes=shard_nodes, queue=queue).drop("k1", "k2").collect()
    assert sorted(tuple(-1 if v is None else v for v in x) for x in got) == plain_trie(rows)


def test_trie_of_nothing_and_of_null_ids(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([(None, 0, "a", "b")], schema)).count() == 0


def test_long_conversation_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(c, t, "r", f"t{t}") for c in (20, 21, 22) for t in range(100)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.rebuilt_trie(frame, shard_nodes=50).drop("k1", "k2").collect()
    assert sorted(tuple(-1 if v is None else v for v in x) for x in got) == plain_trie(rows)


def test_queue_spills_in_order():
    r = random.Random(1)
    entries = [(r.randrange(50), i) for i in range(500)]
    queue = prefix_trie.SpillingQueue(7)
    out = []
    for i, e in enumerate(entries):
        queue.push(e)
        if i % 5 == 4:
            assert queue.front() == min(set(entries[:i + 1]) - set(out))
            out.append(queue.pop())
    while queue.front() is not None:
        out.append(queue.pop())
    assert queue.spilled > 10 and sorted(out) == sorted(entries) and out[100:] == sorted(out[100:])


# vector codes

def plain_codes(rows, entries=256, parts=4):
    clean = [(i, l, [int((x * 1024) // 1) for x in v]) for i, v, l in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    first = {}
    for i, _, v in clean:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    start = [first[i] for i in sorted(first)[:entries]]
    n = len(start[0])
    clean = [x for x in clean if len(x[2]) == n]
    edge = [n * i // parts for i in range(parts + 1)]
    books = [[v[a:b] for v in start] for a, b in zip(edge, edge[1:])]

    def assign(v):
        out = []
        for book, a, b in zip(books, edge, edge[1:]):
            far = [sum((x - y) ** 2 for x, y in zip(v[a:b], e)) for e in book]
            out.append((far.index(min(far)), min(far)))
        return out
    for _ in range(4):
        found = [assign(v) for _, _, v in clean]
        for p in range(parts):
            for e in range(len(start)):
                held = [v[edge[p]:edge[p + 1]] for (_, _, v), f in zip(clean, found) if f[p][0] == e]
                if held:
                    books[p][e] = [sum(c) // len(held) for c in zip(*held)]
    found = [assign(v) for _, _, v in clean]
    errors = collections.Counter()
    for (_, l, _), f in zip(clean, found):
        errors[l] += sum(d for _, d in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e, _ in f), min(sum(d for _, d in f), 2**63 - 1), min(errors[l], 2**63 - 1), digest) for (i, l, _), f in zip(clean, found)]


def vectors(r, n, dim, grid):
    return [(i, [float(np.float32(r.choice(grid) if grid else r.gauss(0, 1))) for _ in range(dim)], r.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("dim, grid, entries", [(8, None, 256), (8, [0.0, 0.001, -0.001], 40), (10, None, 16)])
def test_codes_against_all_entries(spark, dim, grid, entries):
    r = random.Random(dim)
    rows = vectors(r, 300, dim, grid)
    rows += [(900, None, 1), (901, [1.0] * (dim - 1) + [None], 1), (902, [float("nan")] * dim, 0), (903, [float("-inf")] + [0.0] * (dim - 1), 0),
             (904, [0.0] * (dim + 4), 0), (905, [], 1), (None, [0.5] * dim, None), rows[3], (3, [9.0] * dim, 1)]
    frame = spark.createDataFrame([(*x, "c", 0) for x in rows], "vec_id long, embedding array<float>, label int, code string, vec int")
    got = orchard_codes.compress(frame, entries=entries).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(plain_codes([x for x in rows if x[0] != 904], entries), key=key)


def test_codes_of_very_large_components(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([1e300, -1e17, 3.5, 0.0, 2.0**40 + 0.25]) for _ in range(4)], 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, orchard_codes.compress(frame, entries=8).collect())) == sorted(plain_codes(rows, 8))


def test_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)], [(None, [1.0] * 4, 1)]):
        got = orchard_codes.compress(spark.createDataFrame(rows, schema))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


def test_orchard_search_finds_the_least_entry_of_equals():
    r = np.random.default_rng(0)
    book = r.integers(-3, 4, (200, 3))
    x = r.integers(-4, 5, (500, 3))
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    at, best = orchard_codes.Codebook(book).nearest(x)
    assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()

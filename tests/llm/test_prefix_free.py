import random

from inferna.llm import prefix_free

SCHEMA = "doc_id long, text string, k string, spans int"


def brute(bodies, length):
    """Covered bytes by a dictionary of all strings."""
    seen = {}
    for d, b in enumerate(bodies):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i:i + length], []).append((d, i))
    gone = [bytearray(len(b)) for b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i:i + length] = b"\1" * length
    out = []
    for b, g in zip(bodies, gone):
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((len(b), sum(g), spans, bytes(c for c, x in zip(b, g) if not x)))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    share = [word(r.randint(15, 60)) for _ in range(6)]
    out = ["", None, "ab" * 40, "a" * 100, "short", word(19)]
    for _ in range(40):
        out.append("".join(r.choice([word(r.randint(0, 30)), r.choice(share), r.choice(share)[:r.randint(1, 40)]]) for _ in range(5)))
    return out + out[6:10] + [out[7]]


def check(spark, docs, length, window):
    got = prefix_free.remove_repeats(spark.createDataFrame(docs, SCHEMA), length=length, window=window).collect()
    want = brute([(t or "").encode() for _, t, _, _ in docs], length)
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got) == sorted(want)
    assert sorted(x.doc_id or -1 for x in got) == sorted(d[0] or -1 for d in docs)


def test_against_all_strings(spark):
    t = texts(3)
    docs = [(i, x, "c", 1) for i, x in enumerate(t)] + [(None, t[12], None, None), (3, t[3], "c", 1), (3, t[3], "c", 1)]
    check(spark, docs, 20, 10)


def test_large_classes_and_segments(spark, monkeypatch):
    monkeypatch.setattr(prefix_free, "CLASS_ENTRIES", 2)
    monkeypatch.setattr(prefix_free, "SEGMENT", 37)
    monkeypatch.setattr(prefix_free, "PARCEL", 64)
    check(spark, [(i, x, "c", 1) for i, x in enumerate(texts(5))], 20, 10)


def test_empty(spark):
    assert prefix_free.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0

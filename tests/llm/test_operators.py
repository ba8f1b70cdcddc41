"""Edge cases and brute-force versions on small frames: nulls, empty texts, ties, repeats, clashing columns."""

import gzip
import hashlib
import io
import random
import re
import tracemalloc
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inferna.llm import (bag_minhash, cotraining, hash_forest, line_templates, packing, paragraph_bands, shingles,
                         url_filter, warc_zip, winnow)

#: Documents with columns named as the operators' own.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, k string, entry string, label int, body string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "e", 2, "b") for i, t in texts], DOCS)


def prose(seed, n, vocab=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "one"), (None, "some words in a text without a key at all here"), (4, "\n\n"), (5, "x " * 3000)]


# urls

def plain_rule(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h.count("."), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_urls_against_all_rules(spark):
    r = random.Random(1)
    labels, paths = ["a", "b", "org", "com", "é"], ["/", "/x", "/x/", "/x/y", "", "/\u00ff"]
    rules = list({(".".join(r.choices(labels, k=r.randint(1, 3))), r.choice(paths)): r.choice(["allow", "block"]) for _ in range(40)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "", "no scheme", "http://", "http://ORG/x", "http://a.org:80/x", "file:///etc", "http://b.a.org/x/y?q#f", "http://a..org/x"]
    urls += ["http://" + ".".join(r.choices(labels, k=r.randint(1, 4))) + r.choice(paths) + r.choice(["", "?a://b/", "zz"]) for _ in range(150)]
    pages = spark.createDataFrame([(i if i else None, u, "r", "h") for i, u in enumerate(urls + urls[:9])], "page_id long, url string, rule string, host string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules + rules[:2], "host string, path string, verdict string"))
    want = [(i if i else None, *plain_rule(u, rules)) for i, u in enumerate(urls + urls[:9])]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {x.verdict for x in url_filter.filter_urls(pages, none).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0


# archives

def test_packages_against_zipfile():
    for zip64 in (False, True):
        out = io.BytesIO()
        w = warc_zip.PackageWriter(out, zip64)
        members = {"archive/a": b"x" * 1000, "indexes/é": b"", "c": bytes(range(256))}
        for n, d in members.items():
            w.add(n, d)
        w.close()
        with zipfile.ZipFile(out) as z:
            assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == members
        found = list(warc_zip.directory(out, len(out.getvalue())))
        assert {n: out.getvalue()[s:s + size] for n, _, s, size in found} == members
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("archive/a", "w", force_zip64=True) as f:
            f.write(b"abc")
        z.comment = b"a comment"
    (name, method, start, size), = warc_zip.directory(out, len(out.getvalue()))
    assert (name, method, out.getvalue()[start:start + size]) == ("archive/a", 0, b"abc")


def test_scan_without_index():
    parts = [gzip.compress(b"one" * 50000), gzip.compress(b""), gzip.compress(b"two")]
    data = io.BytesIO(b"junk" + b"".join(parts))
    spans = warc_zip.scan_member(data, 4, sum(map(len, parts)))
    assert [gzip.decompress(data.getvalue()[s:s + n]) for s, n in spans] == [b"one" * 50000, b"", b"two"]


def test_archive_round_trip(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>", "z"), (2, None, None, "z"), (3, "u", "", "z"), (4, "u", "<p>é</p>", "z"),
             (4, "u", "<p>é</p>", "z"), (None, "u", "<p>é</p>", "z"), (7, "u", "long\r\n\r\n" * 9000, None)]
    t = spark.createDataFrame(pages, "page_id long, url string, html string, path string")
    got = warc_zip.round_trip(t).collect()
    best = {"<p>é</p>": 4, "": 3, "long\r\n\r\n" * 9000: 7}
    want = [(i, len((h or "").encode()), warc_zip.b32((h or "").encode()), "response" if i == best[h or ""] else "revisit",
             None if i == best[h or ""] else best[h or ""]) for i, _, h, _ in pages]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc_zip.round_trip(t.limit(0)).count() == 0


# nearest neighbours

def test_forest_recall_and_ties(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 32))
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 32, 1), (5002, [float("nan")] * 32, 1), (5003, [None] * 32, 1), (5004, [1.0], 1), (None, [1.0] * 32, 1), (20, x[20].tolist(), 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = hash_forest.nearest(t, t["vec_id"] % 20 == 0, shard_rows=1500, block_rows=64).collect()
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert set(by) == set(range(0, 3000, 20))
    hit = 0
    for q, found in by.items():
        found.sort()
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert np.allclose([f[2] for f in found], [x[f[1]] @ x[q] for f in found], atol=1e-9)
        hit += len({f[1] for f in found} & set(order))
    assert hit / (20 * len(by)) >= 0.9
    # the copies of a query come first, by id
    assert [f[1] for f in by[120]][:20] == [i for i in range(100, 140) if i != 120][:20]
    assert hash_forest.nearest(t.limit(0), t["vec_id"] % 20 == 0).count() == 0


# paragraphs and documents

def edited(text, places, seed):
    w, r = text.split(" "), random.Random(seed)
    for p in r.sample(range(len(w)), places):
        w[p] = f"new{seed}{p}"
    return " ".join(w)


def links(texts, similarity, weighted):
    """Components of all pairs, by plain multisets."""
    from collections import Counter
    bags = []
    for t in texts:
        w = (t or "").lower().split()
        bags.append(Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    if not weighted:
        bags = [Counter(set(b)) for b in bags]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and (bags[i] & bags[j]).total() >= similarity * (bags[i] | bags[j]).total():
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def corpus():
    base = [prose(s, 120) for s in range(6)]
    out = [edited(b, n, 100 * i + n) for i, b in enumerate(base) for n in (0, 1, 3, 4, 30)] + base[:2]
    return out + [("rep " * 40 + prose(77, 20)), ("rep " * 42 + prose(77, 20)), "A few words", "a  FEW words", "other"]


def partition(labels):
    groups = {}
    for i, g in enumerate(labels):
        groups.setdefault(g, set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_near_documents_against_all_pairs(spark):
    t = corpus()
    got = bag_minhash.near_duplicates(frame(spark, list(enumerate(t)) + [(None, t[0]), (900, None), (901, ""), (0, t[0])])).collect()
    of = {g.doc_id: g for g in got if g.doc_id is not None}
    assert partition([of[i].class_id for i in range(len(t))]) == partition(links(t, 0.8, True))
    assert all(of[i].keep == (of[i].class_id == i) for i in of) and of[900].keep and of[901].keep
    assert len(got) == len(t) + 4 and [g.keep for g in got if g.doc_id is None] == [True]
    assert bag_minhash.near_duplicates(frame(spark, [])).count() == 0


def plain_paragraphs(text, span, window):
    """Paragraphs by the docstring, from plain lists: (first word, words)."""
    every, out, at = text.split(), set(), 0
    for line in text.split("\n"):
        n = len(line.split())
        if n >= span + window - 1:
            out.add((at, n))
        at += n
    if every:
        h, first = shingles.word_hashes([text])
        v = paragraph_bands.grams(h, len(every) - np.arange(len(every)), 3).tolist()
        v = [2**64 - 1 if i and every[i - 1:i + 2] == every[i:i + 3] else x for i, x in enumerate(v)][:max(1, len(every) - span + 1)]
        for s in range(max(1, len(v) - window + 1)):
            w = v[s:s + window]
            if len(v) <= window or min(w) < 2**64 - 1:
                out.add((s + w.index(min(w)), min(span, len(every))))
    return out


def test_near_paragraphs_against_all_pairs(spark):
    body = corpus()
    docs = [(i, f"intro {i}\n{t}\n\n{prose(500 + i, 7)} {body[(7 * i) % len(body)]}") for i, t in enumerate(body)]
    docs += [(500, "same same " * 200), (501, "x " + "same " * 90), (502, prose(3, 120) + "\n" + prose(3, 120))]
    every = [(i, at, n, " ".join(t.split()[at:at + n])) for i, t in docs for at, n in sorted(plain_paragraphs(t, 12, 39))]
    group = links([p for *_, p in every], 0.8, False)
    many = {g for g in group if len({e[0] for e, h in zip(every, group) if h == g}) > 1}
    t = frame(spark, docs + [(901, None), (902, ""), (903, " \n "), (None, body[0]), docs[0]])
    found = paragraph_bands.repeated_paragraphs(t)
    got = {(g.doc_id, g.first_word, g.n_words): g for g in found.collect()}
    want = {e[:3]: g for e, g in zip(every, group) if g in many}
    assert set(got) == set(want) and len(got) == found.count()
    order = sorted(want)
    assert partition([got[o].class_id for o in order]) == partition([want[o] for o in order])
    first = {g: min(o for o in order if want[o] == g) for g in many}
    assert all(got[o].removed == (o[0] != first[want[o]][0]) and got[o].class_doc == first[want[o]][0] for o in order)
    rows = paragraph_bands.remove_paragraphs(t, found)
    assert rows.columns == t.columns
    kept = {r.doc_id: r.text for r in rows.collect()}
    for i, text in docs:
        gone = {w for o in order if o[0] == i and got[o].removed for w in range(o[1], o[1] + o[2])}
        assert kept[i].split() == [w for n, w in enumerate(text.split()) if n not in gone]
        assert gone or kept[i] == text
    assert kept[901] is None and kept[902] == "" and kept[None] == body[0]
    assert paragraph_bands.repeated_paragraphs(frame(spark, [])).count() == 0


def test_shared_passages_meet_whatever_surrounds_them(spark):
    passage = [prose(9000 + i, 50) for i in range(12)]
    docs = [(100 * i + j, f"{prose(100 * i + j, 11 + 9 * j)}{' ' if j else chr(10)}{p} {prose(777 * i + j, 23)}")
            for i, p in enumerate(passage) for j in range(3)]
    docs += [(5000, "long " + prose(1, 170000) + " " + passage[0]), (5001, prose(2, 300))]
    clash = frame(spark, docs).withColumnsRenamed({"id": "spans", "k": "_id", "entry": "_gone", "body": "row"})
    found = paragraph_bands.repeated_paragraphs(clash)
    assert {r.doc_id for r in found.collect()} == {i for i, _ in docs} - {5001}
    assert paragraph_bands.remove_paragraphs(clash, found).columns == clash.columns


def test_runs_of_every_place_against_all_windows(spark):
    """Each run of 12 words that several documents share, wherever it begins, by plain sets of shingles; the hot way gives the same."""
    body = corpus()
    docs = [(i, f"{prose(100 + i, 9)} {t}") for i, t in enumerate(body)]
    docs += [(300 + 10 * j + i, f"{prose(3000 + 10 * j + i, 15)} {prose(700 + j, n)}\n{prose(4000 + 10 * j + i, 20)}")
             for j, n in enumerate([11, 12, 13, 20, 49]) for i in range(3)]
    docs += [(500, "same " * 40), (501, "x " + "same " * 14), (502, "a b c d e f g " * 4), (503, "b c d e f g a " * 3), (504, "short one"), (505, "short one")]
    docs += [(901, None), (902, ""), (903, " \n "), (None, docs[0][1]), docs[0], (1, "another row of key one " + prose(703, 20))]
    at = {}
    for i, t in docs:
        w = (t or "").split()
        for a in range(len(w) - 11) if i is not None else ():
            at.setdefault(frozenset(tuple(w[a + b:a + b + 5]) for b in range(8)), set()).add((i, a))
    shared = [x for x in at.values() if len({i for i, _ in x}) > 1]
    want = {(*o, min(x)[0], len(x)) for x in shared for o in x}
    assert len(want) > 100 and {o[0] for o in want} >= {310, 322, 341, 500, 501, 502, 503}
    t = frame(spark, docs)
    for most in (200_000, 2, 0):
        got = paragraph_bands.repeated_runs(t, most=most).collect()
        assert {(g.doc_id, a, g.class_doc, g.class_size) for g in got for a in range(g.first_word, g.first_word + g.n_words - 11)} == want
        assert all(g.removed == (g.doc_id != g.class_doc) for g in got)
        assert [(g.first_word, g.n_words, g.class_doc, g.class_size) for g in got if g.doc_id == 342] == [(15, 49, 340, 3)]
    found = paragraph_bands.repeated_passages(t)
    kept = {r.doc_id: r.text for r in paragraph_bands.remove_paragraphs(t, found).collect()}
    assert kept[311].split() == (prose(3011, 15) + " " + prose(4011, 20)).split() and kept[301] == dict(docs)[301]  # 12 words go, 11 stay
    assert kept[310] == dict(docs)[310] and kept[505] == "" and kept[None] == docs[0][1]
    assert paragraph_bands.repeated_passages(frame(spark, [])).count() == 0


def test_runs_take_memory_for_a_portion_of_a_batch_only():
    """A task's texts arrive as one batch; the steps that look at every place hold the numbers of a small part of them."""
    text = [prose(i, 400) for i in range(40)] * 80
    body, ids = pa.array(text), pa.array(range(len(text)))
    size = sum(map(len, text))
    assert size > 6 << 20

    class Step:
        def mapInArrow(self, read, schema):
            self.read = read
            return self

        groupBy = applyInArrow = lambda self, *_: self

    step = Step()
    paragraph_bands.recurring_least(step, "bigint", 5, 12, 256)
    tracemalloc.start()
    try:
        shingles.word_hashes(text)
        assert tracemalloc.get_traced_memory()[1] < 15 * size
        tracemalloc.reset_peak()
        rows = sum(b.num_rows for b in step.read([pa.RecordBatch.from_arrays([ids, body], names=["id", "body"])]))
        assert rows > 0 and tracemalloc.get_traced_memory()[1] < 10 * size
    finally:
        tracemalloc.stop()


def test_portions_and_gathered_lose_no_row():
    body = pa.array(["é" * 30, "", "b" * 90, "c", "", "d" * 200, "e"]).slice(1)
    parts = list(paragraph_bands.portions(body, 100))
    assert [s for s, _ in parts] == [0, 4, 5] and [t for _, x in parts for t in x] == body.to_pylist()
    assert list(paragraph_bands.portions(body.slice(0, 0))) == []
    pieces = [(np.arange(n), np.arange(n) * 2) for n in (0, 3, 0, 4, 2, 1)]
    for least in (1, 5, 100):
        a, b = (np.concatenate(x) for x in zip(*paragraph_bands.gathered(pieces, least)))
        assert list(a) == [0, 1, 2, 0, 1, 2, 3, 0, 1, 0] and np.array_equal(b, 2 * a)
    assert list(paragraph_bands.gathered([(np.arange(0),)])) == []


def test_weighted_signature_is_unbiased():
    r = np.random.default_rng(1)
    a, b = {i: int(r.integers(1, 9)) for i in range(60)}, {i: int(r.integers(1, 9)) for i in range(20, 90)}
    true = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(90)) / sum(max(a.get(i, 0), b.get(i, 0)) for i in range(90))
    agree = []
    for s in range(80):
        h = shingles.mix(np.arange(90, dtype=np.uint64) + np.uint64(1000 * s + 7))
        sig = bag_minhash.signatures(np.concatenate([h[list(a)], h[list(b)]]), np.repeat([0, 1], [len(a), len(b)]),
                                     np.array([*a.values(), *b.values()]), 2, 64)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - true) < 0.02


# packing

def test_packing_is_whole_and_certified(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = EDGE + [(10 + i, prose(i, 5 + i * 13)) for i in range(40)] + [(60, " a  b\n\n c <|endoftext|> d"), (60, " a  b\n\n c <|endoftext|> d")]
    got = packing.pack_documents(frame(spark, texts), path, capacity=128, group_pieces=30).collect()
    want = []
    for i, t in texts:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        cut = [len(ids) % 128 or 128]
        while cut[-1] < len(ids):
            cut.append(cut[-1] + 128)
        for p, (s, e) in enumerate(zip([0, *cut], cut)):
            want.append((i, p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(g)[:5] for g in got), key=key) == sorted(want, key=key)
    bins = {}
    for g in got:
        bins.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 128
    lengths = np.array([w[3] for w in want])
    assert packing.lower_bound(lengths, 128) <= len(bins) <= packing.lower_bound(lengths, 128) + 2
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_bounds_and_best_fit():
    r = np.random.default_rng(2)
    for _ in range(30):
        n = r.integers(1, 64, r.integers(1, 40))
        bins = packing.best_fit(n, 64)
        assert np.bincount(bins, weights=n).max() <= 64
        assert -(-n.sum() // 64) <= packing.lower_bound(n, 64) <= bins.max() + 1
    assert packing.lower_bound(np.array([33] * 5), 64) == 5 and packing.lower_bound(np.array([], dtype=int), 64) == 0


# benchmark passages

def plain_hits(text, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        grams = {tuple(v[a:a + n]) for a in range(len(v) - n + 1)} if n else set()
        for a in range(len(w) - n + 1):
            if n and tuple(w[a:a + n]) in grams:
                hit.update(range(a, a + n))
                if i is not None:
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_winnowing_against_all_windows(spark):
    items = [(1, prose(1, 30)), (22, prose(2, 10)), (3, "three short words"), (4, "One"), (5, None), (6, ""), (7, "the " * 14), (None, prose(8, 12)), (9, prose(1, 30))]
    w1, w2 = prose(1, 30).split(), prose(2, 10).upper()
    docs = EDGE + [(10, prose(50, 40) + ", " + " ".join(w1[3:14]) + " " + prose(51, 9)), (11, " ".join(w1[:9]) + " no"), (12, w2 + "!" + w2),
                   (13, "THE-" * 30 + "three short;words"), (14, prose(8, 12)), (14, prose(8, 12)), (15, prose(1, 30) + " é " + prose(2, 9))]
    got = winnow.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(i, *plain_hits(t, items, 10)) for i, t in docs]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(g.contaminated for g in winnow.decontaminate(frame(spark, docs), none).collect())
    assert winnow.decontaminate(frame(spark, []), none).count() == 0


# lines

def test_recurring_templates(spark):
    note = "Copyright 20%02d by the authors of this page, all rights reserved by the people of %s under no terms at all"
    docs = [(i, f"{prose(i, 20)}\nPage {i} of 99 pages here\n{note % (i, 'place' + chr(97 + i % 20))}\n{prose(900 + i, 12)}") for i in range(30)]
    edge = [(i and 500 + i, t) for i, t in EDGE] + [(600, "a b c\n\nd")]
    copies = [(100 + i, docs[0][1]) for i in range(20)] + [(200 + i, prose(5000, 30)) for i in range(20)]
    got = {r.doc_id: r for r in line_templates.drop_recurring(frame(spark, docs + copies + edge)).collect()}
    for i, t in docs[1:]:
        a, _, _, b = t.split("\n")
        assert (got[i].text, got[i]._n_lines, got[i]._n_dropped) == (f"{a}\n{b}", 4, 2)
    for i, t in docs[:1] + copies + edge:
        assert got[i].text == t and got[i]._n_dropped == 0  # the first document, its copies, lone texts
    assert got[1].lang == "en" and got[1].body == "b"
    assert line_templates.drop_recurring(frame(spark, [])).count() == 0


def test_shared_passages_of_few_texts(spark):
    """Lines of 50 words or more that 2 to 9 unlike texts share, against a plain count of the texts."""
    r = random.Random(9)
    passages = [prose(7000 + p, n) for p, n in enumerate([50, 50, 51, 80, 200, 60, 70, 90])]
    lines = {i: [prose(8000 + i, 60), prose(8100 + i, 20)] for i in range(40)}
    for p, passage in enumerate(passages):
        for i in r.sample(sorted(lines), p + 2):
            lines[i].insert(r.randrange(len(lines[i]) + 1), passage)
    for i in (0, 1, 2):
        lines[i].append(prose(8500, 49))  # short of a passage, in three texts
    for i in (3, 4):
        lines[i].append(prose(8600, 55).replace("w1", f"{i}w1"))  # about a tenth and more differs
        lines[i].append(f"On 2024-01-0{i} " + prose(8700, 60).replace("w", "word").replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")))
    docs = [(i, "\n".join(x)) for i, x in lines.items()]
    copies = [(100 + i, docs[i][1]) for i in range(40)]
    got = {x.doc_id: x.text for x in line_templates.drop_recurring(frame(spark, docs + copies)).collect()}
    seen, want = set(), {}
    for i, x in lines.items():
        as_one = [re.sub(r"^On 2024-01-0\d ", "On 2024 ", t) for t in x]
        want[i] = "\n".join(t for t, u in zip(x, as_one) if len(t.split()) < 50 or u not in seen)
        seen |= set(as_one)
    assert got == want | {100 + i: want[i] for i in lines}
    assert sum(want[i] != t for i, t in docs) > 20


def test_short_lines_and_bounded_fields(spark):
    """Lines of one or two words, word fields in short lines, two fields in longer ones; unique stretches stay."""
    names = ["ann", "bob", "cy", "dee", "eve", "flo", "gus", "hal", "ivy", "jo", "kim", "lee"]
    tail = " ".join(f"end{chr(97 + j)}" for j in range(12))
    docs = []
    for i, name in enumerate(names):
        unique = " ".join(f"{name}{chr(97 + j)}" for j in range(4))
        docs.append((i, "\n".join([
            prose(i, 20), "Next", "Read more", f"Posted by {name} in {names[i * 5 % 12]}x",
            f"This fine page was written by {name} and the people of {name}town under no terms at all",
            f"One quarter of this long line {unique} {tail[:40]}"])))
    got = {x.doc_id: x.text for x in line_templates.drop_recurring(frame(spark, docs)).collect()}
    assert got[0] == docs[0][1]
    for i, t in docs[1:]:
        x = t.split("\n")
        assert got[i] == f"{x[0]}\n{x[5]}"
    assert line_templates.drop_recurring(frame(spark, docs[:9])).where("_n_dropped > 0").count() == 0


def test_only_frequent_tokens_are_counted_on(spark, monkeypatch):
    """Of the tokens of a leaf those of too few texts are alike: their counts are not kept, and lines of such tokens do not travel."""
    written, stage = {}, line_templates.stage
    monkeypatch.setattr(line_templates, "stage", lambda df, name, *a: written.setdefault(name, stage(df, name, *a)))
    docs = [(i, f"Read more about {prose(i, 12)}\nThis page was made by name{chr(97 + i)} for all of you") for i in range(12)]
    got = {x.doc_id: x for x in line_templates.drop_recurring(frame(spark, docs)).collect()}
    assert [got[i].text for i in range(12)] == [docs[0][1]] + [t.split("\n")[0] for _, t in docs[1:]]
    often = [r.often for r in written["line-often"].collect()]
    assert often and min(often) >= 10 and len(often) == 9 + 3  # of the second line all but the name; "Read more about"


# quality

def test_cotraining_on_held_out_labels(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        bad = r.random() < 0.3
        text = "BUY NOW!! " * r.randint(5, 60) if bad else prose(i, r.randint(20, 200)).replace("w", "the ") + "."
        docs.append((i, text, "en", "src" + str(r.randrange(3) + 3 * bad), len(text)))
        if i < 300:
            labels.append((i, 0 if bad else 1, 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    t = spark.createDataFrame(docs + [(None, None, None, None, None), (999, "", "en", "s", 0)], schema)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = cotraining.classify(t, marks, max_pool=200).collect()
    assert len(got) == 602
    right = [g._keep == (not g.text.startswith("BUY")) for g in got if g.doc_id is not None and 300 <= g.doc_id < 600]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= g._score <= 1 for g in got)
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(g._keep for g in cotraining.classify(t, one).collect())
    assert cotraining.classify(t.limit(0), marks).count() == 0


def test_toxic_labels_reject(spark):
    """Toxic documents of good quality, held out: recall, and loss of clean ones."""
    r = random.Random(14)
    insults = ["idiot", "scum", "moron", "loser", "trash"]
    docs, labels, toxic = [], [], {}
    for i in range(900):
        words = prose(i, r.randint(30, 200)).replace("w", "lo").split()
        toxic[i] = i % 6 == 0
        for _ in range(toxic[i] * r.randint(2, 4)):
            words[r.randrange(len(words))] = r.choice(insults)
        bad = r.random() < 0.1
        docs.append((i, "BUY NOW!! " * 30 if bad else " ".join(words), "en", "src" + str(i % 3), 1))
        toxic[i] &= not bad
        if i < 500:
            labels.append((i, 0 if bad else 1, int(toxic[i])))
    t = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = cotraining.classify(t, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [g for g in got if g.doc_id >= 500 and not g.text.startswith("BUY")]
    recall = [not g._keep for g in held if toxic[g.doc_id]]
    loss = [not g._keep for g in held if not toxic[g.doc_id]]
    assert sum(recall) / len(recall) > 0.9 and sum(loss) / len(loss) < 0.05


def test_cotraining_pool_is_whole(spark):
    """Thresholds and refits over every unlabelled document, against plain counts and a fit in one place."""
    r = random.Random(24)
    docs = []
    for i in range(4700):
        bad = r.random() < 0.3
        text = "BUY NOW " * r.randint(1, 8) + prose(i, r.randint(2, 10)) if bad else prose(i, r.randint(5, 30)).replace("w", "the ")
        docs.append((i, text, "en", "src" + str(r.randrange(3) + 2 * bad)))
    marks = [(i, int("BUY" not in docs[i][1]), 0) for i in range(300)]
    t = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(40)
    got = cotraining.fit_quality(t, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert got["pool"] == 4400

    def matrices(rows):
        f = [(cotraining.content_features(x[1], got["telling"]), cotraining.meta_features(x[3], x[2], len(x[1]))) for x in rows]
        return [np.stack(c).astype(np.float16).astype(np.float64) for c in zip(*f)]

    ids = spark.range(4700).selectExpr("id", "xxhash64(id) h", "pmod(xxhash64(5, id), 5) = 0 held").orderBy("id").toPandas()
    views, own = matrices(docs[300:]), matrices(docs[:300])
    u = (ids.h.to_numpy()[300:].view(np.uint64) >> np.uint64(11)) * 2.0**-53
    train, y = ~ids.held.to_numpy()[:300], np.array([m[1] for m in marks])
    assert len(got["history"]) == 3
    left = np.ones(4400, bool)
    for k, (models, edges) in enumerate(got["history"]):
        for v in (0, 1):
            many, at = int(left.sum() * 0.1), cotraining.bin_of(cotraining.logit(views[v], models[v]))[left]
            low, low_share, high, high_share = edges[v]
            rate = y[train].mean()
            for want, got_n in ((int(many * (1 - rate)), ((at < low) | ((at == low) & (u[left] < low_share))).sum()),
                                (int(many * rate), ((at > high) | ((at == high) & (u[left] < high_share))).sum())):
                assert abs(got_n - want) <= 3 * max(want, 10) ** 0.5
        given, left = cotraining.given_labels(views, u, got["history"][:k + 1])
    for v, name in enumerate(("content", "meta")):
        use = given[v] >= 0
        weight = 0.3 * min(1, train.sum() / use.sum())
        plain = cotraining.fit_logistic(np.vstack([own[v][train], views[v][use]]), np.concatenate([y[train], given[v][use]]),
                                        np.concatenate([np.ones(train.sum()), np.full(use.sum(), weight)]), norm=got["norms"][v])
        assert use.sum() > 100 and np.abs(cotraining.logit(views[v], plain) - cotraining.logit(views[v], got[name])).max() < 0.2


# pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf)
        assert out.columns == columns, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        empty = function(spark, docs.limit(0), sf)
        assert empty.columns == columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.count()


def test_pipeline_stages_beside_their_own_names(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["_entry", "_gone", "_id", "_K1", "_k2", "_keep", "_q", "_n_dropped", "_score"]
    clash = docs.select("*", *[F.col("doc_id").alias(c) for c in names])
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, clash, sf)
        assert out.columns == clash.columns, name
        assert out.where(" or ".join(f"{c} is null or {c} <> doc_id" for c in names)).count() == 0, name
        plain = function(spark, docs, sf)
        assert sorted(map(tuple, out.select(docs.columns).collect())) == sorted(map(tuple, plain.collect())), name


@pytest.mark.parametrize("name", ["op2_warc_zip", "op6_winnow_decontaminate", "op10_url_filter"])
def test_queries_have_sql(name):
    from inferna.llm import catalog
    assert name in catalog.SQL and set(catalog.SQL) <= set(catalog.QUERIES)

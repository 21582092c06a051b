"""Near duplicates, contamination, fingerprints, languages and toxicity against brute force and held-out rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docframe.llm import decontaminate as deco
from docframe.llm import jaccard_join as jj
from docframe.llm.components import components, joined
from docframe.llm.decontaminate import WuManber, decontaminate
from docframe.llm.fingerprint import AT, K, PIECE, SIZE, WORD, fingerprints, likeness, with_sketch
from docframe.llm.jaccard_join import Similarity, jaccard_classes
from docframe.llm import language_id as languages
from docframe.llm.language_id import DIM, grams, language_id, letters, vectors
from docframe.llm.toxicity import fit, toxicity

SCHEMA = "doc_id long, text string, n int, th string"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# -- near duplicates


def family(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \n", "one", "One", "a b c d", "A B C D", "a b c d e", "same same same same same same same"]
    while len(texts) < n:
        t = [r.choice(words) for _ in range(r.choice([5, 6, 8, 9, 12, 20, 45, 120]))]
        texts.append(" ".join(t))
        for _ in range(r.choice([0, 0, 1, 3, 6])):  # versions, each from the one before or from the first
            u = list(t)
            for _ in range(r.randint(0, max(1, len(u) // 25))):
                k = r.randrange(len(u))
                u[k : k + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
            texts.append(r.choice([" ", "\t "]).join(u) if u else "")
            t = r.choice([t, u or t])
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


def brute_classes(rows, words=5, num=80, den=100):
    low = lambda i: -(2**63) if i is None else i
    sets = []
    for i, t, *_ in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s:
            least[find(k)] = min(low(i), least.get(find(k), low(i)))
    out = []
    for k, (i, s) in enumerate(sets):
        c = least[find(k)] if s else low(i)
        out.append((i, len(s), None if c == -(2**63) else c))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,small,sim", [(1, False, Similarity()), (2, True, Similarity()), (3, True, Similarity(3, 60, 100)), (4, True, Similarity(1, 80, 100))])
def test_jaccard_classes(spark, monkeypatch, seed, small, sim):
    if small:  # many buckets, blocks and parts
        for name, value in (("BUCKET", 500), ("HELD", 300), ("CENTRE", 2), ("BLOCK", 2), ("PLACE", 20), ("GROUP_BYTES", 2000), ("BROADCAST", 0), ("CROWD", 3)):
            monkeypatch.setattr(jj, name, value)
    rows = family(seed) + [(None, "one two three four five six", 0, ""), (3, "one two three four five six", 0, ""), (3, "", 0, ""), (3, "", 0, "")]
    got = jaccard_classes(spark.createDataFrame(rows, SCHEMA).repartition(3), sim)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_classes(rows, sim.words, sim.num, sim.den)


def test_every_linked_pair_shares_a_probed_key():
    """The pigeonhole itself, on random sets at the threshold, for all sizes and both bands."""
    r, sim = np.random.default_rng(5), Similarity(1)
    for trial in range(400):
        n = int(r.integers(1, 400))
        own = r.choice(1 << 20, n, replace=False)
        take = int(r.integers(0, n // 5 + 1))
        drop = int(r.integers(0, take + 1))
        other = np.concatenate((own[drop:], (1 << 20) + r.choice(1 << 20, take - drop, replace=False)))
        texts = [" ".join(f"t{x}" for x in s).encode() for s in (own, other)]
        sets = jj.Sets(jj.Chunk(texts), sim)
        common = len(np.intersect1d(sets.of(0), sets.of(1)))
        if not sim.linked(common, *sets.size.tolist()):
            continue
        doc, key = jj.keys(sets, np.array([True, True]), sim)
        plain = key & ~np.uint64(1)
        shared = np.intersect1d(plain[doc == 0], plain[doc == 1])
        assert len(shared) and (np.isin(plain, shared) & (key & np.uint64(1)).astype(bool)).any(), (n, take, drop)


def test_jaccard_of_nothing(spark):
    assert jaccard_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    got = jaccard_classes(spark.createDataFrame([(1, None, 0, ""), (2, "", 0, "")], SCHEMA))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(500, x) for x in range(501, 540)]
    got = {row["node"]: row["component"] for row in components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {x: x for l in links for x in l}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {x: c for x, c in least.items() if x in got} and all(x in got for a, b in links if a != b for x in (a, b))
    first, rest = (spark.createDataFrame(p, "a long, b long") for p in (links[::2], links[1::2]))
    assert {row["node"]: row["component"] for row in joined(components(first), rest).collect()} == got


# -- contamination


def test_wu_manber_finds_every_occurrence():
    r = np.random.default_rng(3)
    text = r.integers(0, 4, 3000).astype(np.uint64)
    for m in (1, 2, 3, 10):
        patterns = np.unique(np.concatenate([np.stack([text[i : i + m] for i in r.integers(0, 2990, 20)]), r.integers(0, 4, (5, m)).astype(np.uint64)]), axis=0)
        lo, hi = np.array([0, 1000, 1000, 1003]), np.array([1000, 1000, 1003, 3000])
        place, pattern = WuManber(patterns, [[str(i)] for i in range(len(patterns))]).search(text, lo, hi)
        s = WuManber(patterns, [[str(i)] for i in range(len(patterns))])
        got = sorted((int(p), tuple(s.patterns[q])) for p, q in zip(place, pattern))
        want = sorted((i, tuple(p)) for a, z in zip(lo, hi) for i in range(a, z - m + 1) for p in patterns if np.array_equal(text[i : i + m], p))
        assert got == [(i, tuple(p)) for i, p in want]


def brute_contamination(docs, items, size=10):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    windows = [("" if i is None else str(i), tuple(w[k : k + min(size, len(w))])) for i, t in items for w in [words(t)] if w for k in range(len(w) - min(size, len(w)) + 1)]
    out = []
    for i, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for name, p in windows:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(name)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontaminate(spark, monkeypatch, block):
    monkeypatch.setattr(deco, "PATTERNS", block)
    monkeypatch.setattr(deco, "SEGMENT", 4)
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(30)] + ["É", "straße"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(None, "only null here"), (20, None), (21, "?!"), (3, "again three words"), (100, items[3][1])]
    docs = [(None, "v1 v2 only NULL here", 0, ""), (1, None, 0, ""), (2, "", 0, ""), (2, "", 0, "")]
    for i in range(40):
        t = [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        if r.random() < 0.6:
            t[3:3] = (r.choice(items)[1] or "").split()
        docs.append((i + 3, r.choice([" ", ", ", "-"]).join(t), 0, ""))
    got = decontaminate(spark.createDataFrame(docs, SCHEMA).repartition(2), spark.createDataFrame(items, "item_id long, text string"))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(got, *names) == brute_contamination(docs, items)


def test_decontaminate_without_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate(spark.createDataFrame([(1, "a b", 0, "")], SCHEMA), none)
    assert [r["contaminated"] for r in got.collect()] == [False]
    assert decontaminate(spark.createDataFrame([], SCHEMA), none).count() == 0


# -- fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else struct.pack("<q", signed(p)), seed)
    return seed


def brute_sketch(text):
    """{hash: first place} of the least SIZE anchors."""
    letters = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text):
        letters += [run] if len(run) <= WORD else [run[i : i + PIECE] for i in range(len(run))]
    one = [hashed(x.encode()) for x in letters]
    two = [hashed(a, b) for a, b in zip(one, one[1:])]
    out = {}
    for i in range(len(one) - K + 1):
        inner = [signed(x) for x in two[i : i + K - 1]]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(hashed(two[i], *two[i + 2 : i + K - 1]) >> 24, i)
    if not out and one:
        out = {hashed(",".join(str(signed(x)) for x in one).encode()) >> 24: 0}
    return dict(sorted(out.items())[:SIZE])


def brute_likeness(a, b):
    least = sorted(set(a) | set(b))[:SIZE]
    common = [h for h in least if h in a and h in b]

    def ordered(x, y):
        places = sorted((x[h], y[h]) for h in common)
        return sum(not i or p[1] > places[i - 1][1] for i, p in enumerate(places))

    return min(ordered(a, b), ordered(b, a)) / len(least) if least else 1.0


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_fingerprints(spark, partitions):
    r = random.Random(9)
    texts = ["", "a", "ab  cd", "x" * 50, "é" * 9] + [" ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 150))) for _ in range(40)]
    texts += texts[20:24] + [texts[30] + " and more"]
    docs = [(7 * i - 60, t) for i, t in enumerate(texts)]
    r.shuffle(docs)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows_of(fingerprints(spark.createDataFrame([(i, t or None, 0, "") for i, t in docs], SCHEMA).repartition(3)), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    docs.sort(reverse=True)
    want = []
    printed = lambda s: "".join(f"{h << AT | at:016x}" for h, at in s.items())
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), brute_likeness(a, b), brute_likeness(a, c)))
    assert got == sorted(want, key=str)


def test_fingerprint_edges(spark):
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprints(spark.createDataFrame([(5, "alone in here", 0, "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0  # its own next document
    rows = [(None, "null id comes last", 0, ""), (1, "twice", 0, ""), (1, "twice", 0, ""), (1, "other", 0, "")]
    got = fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and sum(r["doc_id"] is None for r in got) == 1
    plan = fingerprints(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def one_likeness(spark, a, b):
    rows = with_sketch(with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "x"), "b", "y")
    return likeness(rows, "x", "y", "z").first()["z"]


def test_fingerprints_of_long_runs(spark):
    """One more character in a run without white space, in front or in the middle, leaves the anchors as they are."""
    r = random.Random(3)
    for letters in ("天地玄黄宇宙洪荒日月盈昃辰宿列张", "abcdefghijklmnop0123456789+/", "😀😁😂🤣😃😄😅😆", "a\u3000b\u00a0cdefg"):
        run = "".join(r.choice(letters) for _ in range(3000))
        assert one_likeness(spark, run, letters[0] + run) > 0.9, letters
        assert one_likeness(spark, run, run[:1700] + letters[0] + run[1700:]) > 0.9, letters


def test_fingerprints_know_places(spark):
    """The same anchors in another order don't match."""
    r = random.Random(8)
    blocks = [[f"w{r.randrange(10**6)}" for _ in range(12)] for _ in range(40)]
    text = lambda b: " ".join(w for x in b for w in x)
    assert one_likeness(spark, text(blocks), text(blocks)) == 1.0
    assert one_likeness(spark, text(blocks), text(blocks[20:] + blocks[:20])) > 0.85  # one seam
    assert one_likeness(spark, text(blocks), text(blocks[::-1])) < 0.6


def test_likeness_estimates_the_resemblance(spark):
    """Against the share of common k-mers of all, over whole texts with 0 to 60 of 600 words changed."""
    r = random.Random(5)
    words = [f"v{i}" for i in range(900)]
    off = []
    for changed in range(0, 61, 6):
        a = [r.choice(words) for _ in range(600)]
        b = list(a)
        for k in r.sample(range(600), changed):
            b[k] = r.choice(words)
        x, y = ({tuple(t[i : i + K]) for i in range(len(t) - K + 1)} for t in (a, b))
        off.append(one_likeness(spark, " ".join(a), " ".join(b)) - len(x & y) / len(x | y))
    assert max(map(abs, off)) < 0.25 and abs(sum(off) / len(off)) < 0.08, off


# -- languages


def test_grams_and_bundles():
    doc, gram = grams(["Ab c!".encode(), b"", "12 é".encode(), "𐐀".encode()])
    assert sorted(set(doc.tolist())) == [0, 2, 3] and (doc == 0).sum() == 4  # _ab ab_ b_c _c_
    upper, lower = grams([b"HELLO you"])[1], grams([b"hello  YOU."])[1]
    assert sorted(upper.tolist()) == sorted(lower.tolist())
    v = vectors(np.unique(gram)).astype(float)
    assert abs(v @ v.T / v.shape[1] - np.eye(len(v))).max() < 0.2
    assert len(grams(["12 .. !".encode(), b"\xc3"])[0]) == 0
    every = np.array([p for p in range(0x250, 0x9FFF) if chr(p).isalpha()])
    assert len(np.unique(letters(every), axis=0)) == len(every)  # no two letters share a vector


def brute_languages(docs):
    """(lang_pred, score) by vectors added one by one; docs are (doc_id, text, lang)."""

    def bundle(text):
        out, n = np.zeros(DIM), 0
        low = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
        s = " " + " ".join(low.split()) + " "
        for k in range(len(s) - 2):
            out += np.prod([np.roll(letters(np.array([ord(c)]))[0], 2 - j) for j, c in enumerate(s[k : k + 3])], axis=0)
            n += 1
        return out if low.split() else None

    sums = {}
    for i, t, lang in docs:
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1 and (b := bundle(t)) is not None:
            sums[lang] = sums.get(lang, 0) + b
    out = {}
    for i, t, _ in docs:
        b = bundle(t)
        cosines = [] if b is None else sorted((-(b @ s) / np.linalg.norm(b) / np.linalg.norm(s), lang) for lang, s in sums.items())
        out[i] = (cosines[0][1], max(0, -cosines[0][0])) if cosines else ("und", 0)
    return out


def test_language_id_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(languages, "SLICE", 64)
    r = random.Random(6)
    alphabets = {"la": "abcdefghij", "cy": "абвгдежзик", "gr": "αβγδεζηθικ", "zh": "天地玄黄宇宙洪荒日月"}
    docs = []
    for i in range(80):
        lang = r.choice(list(alphabets))
        own = alphabets[lang] if r.random() < 0.8 else alphabets["la"]
        docs.append((i, " ".join("".join(r.choice(own).upper() for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 20))), lang if r.random() < 0.8 else None))
    got = language_id(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).collect()
    want = brute_languages(docs)
    assert len(got) == len(docs)
    for row in got:
        name, score = want[row["doc_id"]]
        assert row["lang_pred"] == name and abs(row["score"] - score) < 1e-4


def test_language_id(spark):
    r = random.Random(2)
    words = {"xx": ["bala", "boro", "lobo", "oralo"], "yy": ["kith", "myth", "thick", "kimchy"], "zz": ["süß", "größe", "müßig"]}
    docs = [(i, " ".join(r.choice(words[lang]) for _ in range(12)), None if i % 10 == 0 else lang, "s", lang) for i in range(120) for lang in [r.choice(list(words))]]
    docs += [(200, None, "xx", "s", ""), (201, "", "yy", "s", ""), (202, "12 34 !", None, "s", ""), (None, "bala boro", None, "s", "xx"), (203, "bala", "xx", "s", "xx"), (203, "bala", "xx", "s", "xx")]
    got = language_id(spark.createDataFrame([d[:4] for d in docs], "doc_id long, text string, lang string, score string")).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for i, _, _, _, truth in docs:
        assert by[i]["lang_pred"] == (truth or "und") and 0 <= by[i]["score"] <= 1
        assert by[i]["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id(none).count() == 0
    assert [r["lang_pred"] for r in language_id(spark.createDataFrame([(1, "abc", None)], none.schema)).collect()] == ["und"]


# -- toxicity


def bag(r, toxic):
    plain = [" ".join(r.choice(["the", "sun", "is", "up", "we", "go", "far"]) for _ in range(8)) for _ in range(r.randint(2, 12))]
    if toxic:
        plain.insert(r.randint(0, len(plain)), r.choice(["you are an IDIOT today", "what a clown, clown"]))
    return plain


def test_toxicity(spark):
    r = random.Random(4)
    docs, labels, where = [], [], {}
    for i in range(300):
        toxic = r.random() < 0.3
        sentences = bag(r, toxic)
        docs.append((i, ". ".join(sentences) + ".", "x"))
        where[i] = next((k for k, s in enumerate(sentences) if "IDIOT" in s or "clown" in s), None)
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs += [(900, None, ""), (901, "", ""), (None, "the sun", ""), (5, docs[5][1], ""), (902, "the sun is up. " * 3000, "")]
    labels += [(None, 1, 1), (5, 1, None), (7777, 1, 1)]
    got = toxicity(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    for row in got:
        i = row["doc_id"]
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
        assert row["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2)
        assert row["predicted"] == int(where.get(i) is not None), (i, row)
        if where.get(i) is not None:
            assert row["worst_sentence"] == where[i] and row["n_offending"] >= 1
    assert next(r for r in got if r["doc_id"] == 900)["worst_sentence"] is None


def test_toxicity_without_labels(spark):
    docs, none = spark.createDataFrame([(1, "a b", "")], "doc_id long, text string, th string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity(docs, none).collect()] == [0.0]
    assert toxicity(docs.limit(0), none).count() == 0
    assert fit([], np.zeros(0, bool)).leak == 0

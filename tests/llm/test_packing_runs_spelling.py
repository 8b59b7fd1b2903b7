"""Packing, periodic runs and spelling variants against brute force, and the odd cases that all must bear."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import packing, periodic, queries, spelling
from pagemill.session import table

ODD = [None, "", " ", "a", "É中😀 \x00 x", "word " * 30_000, "same text", "same text", "x" * 50_000, "<|endoftext|> J̌ ’twas don’t"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    rows = [(i if i else None, t, None if i % 2 else "en", i, 7, "clash", "clash") for i, t in enumerate(ODD)]
    rows.append(rows[6])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, length int, word string, key string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# 11


def check_packed(rows, texts, limit):
    """rows: (doc_id, piece, start, length, crc, sequence, offset); texts: (doc_id, text) of every row of the table."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            want[doc_id, piece, at, len(part), crc32(part.tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r[5]].append((r[6], r[3]))
    for own in filled.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= limit
    return len(filled)


def test_packing_of_documents(spark, sf_dir, docs):
    got = queries.QUERIES["op11_packing"](spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = [tuple(r) for r in got.collect()]
    n = check_packed(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], 4096)
    assert n <= 1.01 * sum(r[3] for r in rows) / 4096 + 1


@pytest.mark.parametrize("limit", [16, 4096])
def test_packing_of_odd_rows(spark, odd, limit):
    cut = packing.pieces(odd, limit=limit)
    packed = packing.pack(cut, limit, bucket_rows=50)
    rows = [tuple(r) for r in packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    check_packed(rows, [tuple(r) for r in odd.select("doc_id", "text").collect()], limit)
    made = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    ids = {(r.doc_id, r.piece): r.ids for r in cut.collect()}
    for r in packed.collect():
        assert made[r.sequence_id].ids[r.offset : r.offset + r.length] == ids[r.doc_id, r.piece]
    assert packing.digest(odd.limit(0)).count() == 0 and packing.sequences(packing.pack(packing.pieces(odd.limit(0)))).count() == 0


def test_encoding_by_pieces_is_the_librarys():
    r = random.Random(7)
    own = packing.Encoder(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), group=40, chars=200, size=50)
    assert own.in_pieces
    alphabet = list("aZé ßÀ×÷ªµº½²7  \t\n\x0b\x1c\x85\xa0.,'!-_<|>") + ["'s", "'LL", "’", "İ", "Σ", "中", "́", "J̌", " ", "😀", "<|endoftext|>", "Zürich", "don't"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)] + ["y" * 3000, ""]
    want = [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(texts)] == want
    whole = packing.Encoder(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert not whole.in_pieces
    assert [np.frombuffer(b, "<u4").tolist() for b in whole.ids(texts[:50])] == [whole.library.encode(t, add_special_tokens=False).ids for t in texts[:50]]


def test_patterns_are_all_partitions():
    for bins, depth in ((7, 3), (12, 4), (5, 1)):
        want = set()

        def extend(own, left, depth=depth, want=want):
            if left == 0:
                want.add(tuple(sorted(own)))
            elif len(own) < depth:
                for x in range(1, left + 1):
                    extend([*own, x], left - x)

        extend([], bins)
        got = [tuple(np.repeat(np.arange(bins + 1), p).tolist()) for p in packing.patterns(bins, depth)]
        assert len(got) == len(want) and set(got) == want


def test_non_negative_least_squares():
    r = np.random.default_rng(2)
    for _ in range(30):
        a, b = r.normal(size=(8, 12)), r.normal(size=8)
        x = packing.non_negative_least_squares(a, b)
        slope = a.T @ (a @ x - b)  # the conditions of an optimum
        assert (x >= 0).all() and (slope > -1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6
    true = np.array([3, 0, 5, 0, 0, 2.0])
    a = np.abs(r.normal(size=(9, 6)))
    assert np.allclose(packing.non_negative_least_squares(a, a @ true), true)


def fewest(lengths, limit):
    """The fewest sequences, by trying all."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {room: j for j, room in enumerate(rooms) if room >= lengths[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, limit - lengths[i]])

    place(0, [])
    return best


def test_plans_against_the_fewest_sequences():
    r = random.Random(3)
    more = 0
    for _ in range(60):
        lengths = sorted((r.randint(1, 20) for _ in range(r.randint(1, 11))), reverse=True)
        plan = packing.Plan(dict(Counter(lengths)), 20, bins=20)
        more += plan.sequences - fewest(lengths, 20)
    assert more <= 2
    for kind in range(4):
        g = np.random.default_rng(kind)
        own = [g.lognormal(5.5, 1.1, 20_000), g.integers(1, 4097, 20_000), g.integers(1000, 4097, 4000), np.full(999, 1365)][kind]
        own = np.clip(own.astype(int), 1, 4096)
        plan = packing.Plan(dict(Counter(own.tolist())))
        least = max(-(-int(own.sum()) // 4096), int((own > 2048).sum()))
        assert plan.sequences <= least * (1.02 if kind == 2 else 1.004) + 1 and (kind == 3 or plan.by_pattern > plan.sequences / 3)
        assert not plan.left and plan.used == Counter(own.tolist())


# 12


def plain_runs(w, least_words=24, times=3):
    n, out = len(w), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least_words, times * p):
                s = w[i : j + p]
                if not any(s[q:] == s[:-q] for q in range(1, p)):
                    out.append((i, length, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = crc32(("" if doc_id is None else str(doc_id)).encode())
    if rewrite and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    return doc_id, len(runs), *values, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def test_runs_of_documents_by_brute_force(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect())
    short = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 1500}
    assert len(short) > 150 and [r for r in got if r[0] in short] == sorted(plain_row(*r) for r in short.items())
    assert len(got) == docs.count() and sum(r[1] > 0 for r in got) > 5


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words_by_brute_force(seed):
    r = random.Random(seed)
    for _ in range(40):
        group = []
        for _ in range(r.randint(1, 8)):
            n, k = r.choice([0, 1, 5, 24, 40, 80, 150]), r.choice([1, 2, 3, 5, 50])
            w = [r.randrange(k) for _ in range(n)]
            for _ in range(r.randrange(3) if n else 0):
                a = r.randrange(n)
                p, e = r.randint(1, max(1, (n - a) // 3 + 1)), r.randint(a, n)
                w[a:e] = [w[a + (i - a) % p] for i in range(a, e)]
            group.append(w)
        least, times = r.choice([3, 6, 24]), r.choice([2, 3])
        want = [plain_runs(w, least, times) if len(w) >= least else [] for w in group]
        assert periodic.runs_of([np.array(w, np.int64) for w in group], least, times) == want


def test_runs_of_a_long_periodic_text():
    unit = list(range(40_000))
    assert periodic.runs_of([np.array(unit * 4 + [7]), np.array([5] * 300_000)]) == [[(0, 160_000, 40_000)], [(0, 300_000, 1)]]


def test_runs_of_odd_rows(spark, odd):
    got = sorted(map(repr, (tuple(r) for r in periodic.digest(odd, rewrite=None).collect())))
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    small = [plain_row(i, t, False) for i, t in rows if t is None or len(t) < 100_000]
    long = (5, 1, 0, 30_000, 1, 30_000_000, hashlib.sha256(b"0,30000,1\n").hexdigest(), hashlib.sha256(b"word").hexdigest())
    assert got == sorted(map(repr, [*small, long]))
    assert [tuple(r) for r in periodic.runs(odd).collect()] == [(5, 0, 30_000, 1)]
    texts = {r.doc_id: r.text for r in periodic.collapsed(odd).collect()}
    assert texts[5] == "word" and texts[7] == "same text" and texts[None] == "" and len(texts[8]) == 50_000
    assert periodic.digest(odd.limit(0)).count() == 0 and periodic.collapsed(odd.limit(0)).count() == 0


# 13


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Whether the distance is exactly one."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_forms(words):
    """By comparing all pairs of nearly one length."""
    found, form = {}, {}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w, n in words.items():
        own = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        found[w] = len(own)
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, found[w], words[form[w]] if form[w] else None))
    return sorted(rows)


def test_spelling_of_documents_by_brute_force(spark, sf_dir, docs):
    got = queries.QUERIES["op13_spelling_variants"](spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == plain_forms(plain_words([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert sum(r[1] is not None for r in rows) > 20


def test_spelling_of_chains_ties_and_long_words(spark):
    r = random.Random(9)
    words = {"abcde" + "f" * k: 3 * 2**k for k in range(14)} | {"zzzzz": 5, "zzzzy": 10, "zzzzx": 10, "ééééé": 3, "éééé中": 6, "aaaaa": 3, "aaaaaa": 7, "ababab": 4, "bababa": 9}
    for _ in range(300):
        words["".join(r.choice("ab") for _ in range(r.randint(5, 9)))] = r.randint(3, 40)
    base = "".join(r.choice("abc") for _ in range(66))
    for w in (base, base[1:], base[2:], base[:-1], base[:30] + "z" + base[31:], base[:30] + "zz" + base[30:], base[:63], "y" * 20_000, "y" * 20_001, "y" * 9_000 + "x" + "y" * 11_000, base[1:] + base[0]):
        words[w] = r.randint(3, 12)
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(tuple(x) for x in spelling.group(frame).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == plain_forms(words)
    assert spelling.group(frame.limit(0)).count() == 0


def test_spelling_of_odd_rows(spark, odd):
    more = odd.unionByName(odd).unionByName(odd.withColumn("text", F.concat(F.col("text"), F.lit(" word words sAmes ÀÉÎõ× sames,sames SAMES"))))
    rows = [tuple(r) for r in more.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in spelling.report(more).collect()) == plain_forms(plain_words(rows))
    assert spelling.report(odd.limit(0)).count() == 0

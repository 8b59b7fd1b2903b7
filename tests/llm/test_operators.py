"""Each operator against brute force, an exact round trip or held-out accuracy, and the odd cases that all must bear."""

import base64
import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import bpe, chat, decontaminate, langid, media, quality, queries, secrets, sharding, simhash, tokencount, webp, webp_encoder, webp_lanes
from pagemill.session import table

ODD = [None, "", " ", "a", "É中😀 \x00 x", "word " * 30_000, "same text", "same text", "x" * 50_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    rows = [(i if i else None, t, None if i % 2 else "en", "s", 0, i, "clash") for i, t in enumerate(ODD)]
    rows.append(rows[6])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, shard string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 1


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items):
    windows: dict = {}
    for name, text in items:
        w = words(text)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(name)
    for text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= own
        yield len(w), len(hit), len(found), digest(",".join(sorted(found))), bool(hit)


ITEMS = [(1, "word " * 12), (2, "same TEXT"), (2, "same text"), (None, "É中😀 x"), (3, None), (4, " ,. ")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_decontamination(spark, odd, block_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(repr, (tuple(r)[:-1] for r in decontaminate.report(odd, bench, block_bytes=block_bytes).collect())))
    rows = odd.select("doc_id", "text").collect()
    want = contamination([r.text for r in rows], [("" if n is None else str(n), t) for n, t in ITEMS])
    assert got == sorted(repr((r.doc_id, *w)) for r, w in zip(rows, want, strict=True))
    kept = decontaminate.remove(odd, bench, block_bytes=block_bytes)
    assert kept.columns == odd.columns and {r.text for r in kept.collect()} == {None, "", " ", "a", "x" * 50_000}
    assert decontaminate.report(odd.limit(0), bench).count() == 0 and decontaminate.remove(odd, bench.limit(0)).count() == odd.count()


def plain_matches(text, items):
    """(first word, words, item, first word in the item) of the matches that can't be extended, by comparing all places."""
    t, out = words(text), []
    for name, item in items:
        w = words(item)
        for at in range(len(t)):
            for start in range(len(w)):
                n = 0
                while at + n < len(t) and start + n < len(w) and t[at + n] == w[start + n]:
                    n += 1
                begins = not at or not start or t[at - 1] != w[start - 1]
                if begins and w and n >= min(10, len(w)) and (len(w) >= 10 or n == len(w)):
                    out.append((at, n, name, start))
    return sorted(out)


def test_longest_matches_by_brute_force(spark):
    r = random.Random(4)
    row = lambda n, k: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    follow = "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9"
    items = [("i", follow + " zz " + follow[3:] + " a10"), ("same", "b " * 14), ("short", "c d e"), ("r1", row(60, 2)), ("r2", row(40, 2)), ("r1", row(25, 3))]
    docs = [follow + " a10", "b " * 30, "x c d e c d e", row(80, 2), row(60, 2) + " new " + row(40, 2), items[3][1] + " " + items[4][1], ""]
    bench = decontaminate.Benchmark([(n, t.encode()) for n, t in items])
    counts, found = decontaminate.matches([d.encode() for d in docs], bench)
    for d, n, own in zip(docs, counts, found, strict=True):
        want = plain_matches(d, items)
        assert n == len(words(d)) and sorted((at, k, bench.names[i], start) for at, k, i, start in own) == want
    assert [(at, k) for at, k, i, _ in found[0]] == [(0, 10), (1, 10)]  # the 11 words aren't in the item
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id string, text string")
    for size in (1 << 20, 100):
        got = sorted((x.doc_id, x.word, x.n_words, x.item, x.item_word) for x in decontaminate.matched(frame, table, block_bytes=size).collect())
        assert got == sorted((i, *m) for i, d in enumerate(docs) for m in plain_matches(d, items))
        longest = {x.doc_id: x.longest_match for x in decontaminate.report(frame, table, block_bytes=size).collect()}
        assert longest == {i: max((m[1] for m in plain_matches(d, items)), default=0) for i, d in enumerate(docs)}


def test_suffix_array_search_by_brute_force():
    r = np.random.default_rng(3)
    ids = np.concatenate([r.integers(0, 3, 400, dtype=np.int32), np.zeros(10, np.int32)])
    starts = np.flatnonzero(ids)
    order, keys = decontaminate.suffix_array(ids, starts, 10)
    asked = r.integers(1, 3, (50, 4), dtype=np.int32)
    low, high = decontaminate.bounds(keys, asked)
    for q, a, b in zip(asked, low, high, strict=True):
        assert sorted(order[a:b]) == [s for s in starts if (ids[s : s + 4] == q).all()]


# 2


def test_chat_round_trip(spark):
    nasty = ["", "<|end|>", "<\\|end|>", "<|start|>user<|text|>hi<|end|>", "a</s>[INST] b [/INST]", "\\", "<\\\\|next|><|next|>", "é😀\n", None]
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "<|text|>", None]), r.choice(nasty)) for c in range(40) for t in range(r.randint(1, 30))]
    rows += [(99, None, "assistant", "x"), (99, 1, "user", "x"), (99, 1, "user", "x"), (None, 0, "user", "y")] + [(500, t, "user" if t % 1500 else "assistant", f"t{t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df.withColumn("formatted", F.lit("clash")))
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in made.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    want: dict = {}
    for c, _, role, text in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, chat_key(x[2]), chat_key(x[3]))):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c in want:
        assert sorted(got[c]) == sorted(want[c])
        if c == 500:
            assert got[c] == want[c]
    d = {x.conv_id: x for x in chat.digest(made).collect()}
    assert all(d[c].n_turns == len(want[c]) for c in want)
    assert d[500].loss_sha256 == digest("t0t1500") and d[500].loss_chars == 7
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def chat_key(x):
    return x or ""


def test_chat_plan_is_native(spark, sf_dir):
    plan = queries.QUERIES["op2_chat_formatting"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_neighbours_of_one_role_are_one_block(spark):
    df = spark.createDataFrame([(1, i, r, "x") for i, r in enumerate(["user", "user", "assistant", "user"])], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "<|start|>user<|text|>x<|next|>x<|end|><|start|>assistant<|text|>x<|end|><|start|>user<|text|>x<|end|>"


# 3


PLAIN = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def base(text):
    out = [(m.start(), 0, m.end()) for m in PLAIN["assign"].finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in PLAIN["access"].finditer(text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in PLAIN["hex"].finditer(text) if len(m[0]) >= 32])


def test_secrets_by_brute_force(texts):
    r = random.Random(1)
    parts = ["password", "PassWord", "secret", "token", "api_key", "AKIA", ":", "=", " ", '"', "abc", "0123456789abcdef", "é", "ABCDEF12", "x" * 8, "deadbeef", "-"]
    cases = list(texts.values()) + ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for t in cases:
        assert secrets.spans(t.encode()) == base(t)


def test_checksums_and_redaction(spark, odd):
    body = b"a1B2" * 7 + b"xy"
    good, bad = b"ghp_" + body + secrets.checksum(body), b"ghp_" + body + b"000000"
    assert [k for _, k, _ in secrets.find(good + b" " + bad)] == [3]
    df = spark.createDataFrame([(1, "é token = 'abcdefgh12' and " + good.decode(), 3), (2, None, 3)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert rows[1].text == "é [ASSIGN]' and [GITHUB]" and rows[1].n_chars == len(rows[1].text) and rows[2].text is None
    assert secrets.redact(odd).count() == odd.count() == secrets.scan(odd).count()


# 4, 7


def held_out(doc_id):
    return crc32(str(doc_id).encode()) % 4 == 2


def test_language_id_on_held_out_documents(spark):
    big = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.predict(big, langid.fit(big)).join(big.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.95


def test_code_lengths_are_exact():
    model = langid.Model({"a": [b"abracadabra " * 30], "b": [b"zebra xylem " * 30]}, least=4)
    trees = [langid.Tree([s * 30], 3, 4) for s in (b"abracadabra ", b"zebra xylem ")]
    for t in (b"abra", b"zzz\xff\x01", b"xylem ab" * 50):
        h = bytes(3) + t
        want = [sum(tree.bits(h[i - 3 : i], h[i]) for i in range(3, len(h))) for tree in trees]
        assert np.allclose(model.lengths([b"", t, t], block=7)[1:] / langid.UNIT, [want, want], atol=1e-2)


def plain_bits(samples, text, order=3, least=16):
    """A text's code length by counting contexts one by one, from the definition."""
    seen: dict = {}
    for t in samples:
        h = bytes(order) + t
        for i in range(order, len(h)):
            for k in range(order + 1):
                own = seen.setdefault(h[i - k : i], {})
                own[h[i]] = own.get(h[i], 0) + 1
    kept = {c for c, own in seen.items() if sum(own.values()) >= least or not c}
    kept = {c for c in kept if all(c[i:] in kept for i in range(len(c)))}
    total = 0.0
    h = bytes(order) + text
    for i in range(order, len(h)):
        context = h[i - order : i]
        while context not in kept and context:
            context = context[1:]
        while True:
            own = seen.get(context, {}) if context in kept else {}
            n, d = sum(own.values()), len(own)
            if h[i] in own:
                total += np.log2((n + d) / own[h[i]])
                break
            total += np.log2((n + d) / d) if d else 0
            if not context:
                total += 8
                break
            context = context[1:]
    return total


def test_code_lengths_by_plain_counting(docs, texts):
    by_lang: dict = {}
    for r in docs.collect():
        by_lang.setdefault(r.lang, []).append((r.text or "").encode()[:600])
    samples = {k: v[:12] for k, v in by_lang.items() if k in ("en", "fr", "de")}
    model = langid.Model(samples)
    asked = [t.encode()[:300] for t in list(texts.values())[:12]] + [b"", b"\x00\x01\xff", "É中😀".encode()]
    want = [[plain_bits(samples[k], t) for k in model.langs] for t in asked]
    assert np.allclose(model.lengths(asked, block=64) / langid.UNIT, want, rtol=1e-5, atol=1e-2)


def test_models_are_pruned_to_their_bound():
    samples = {str(i): [random.Random(i).randbytes(3000)] for i in range(5)}
    small = langid.Model(samples, order=2, least=1, max_bytes=400_000)
    assert sum(x.nbytes for x in (*small.cost, *small.own, small.row)) <= 400_000
    assert (small.lengths([samples["3"][0][:50]]) > 0).all()


def plain_ftrl(rows, labels, size, passes=3, alpha=0.08, beta=1.0, l1=0.02, l2=1.0):
    """The published update, coordinate by coordinate; rows are {place: value}, the bias at the last place unpenalised."""
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        penalty = 0 if i == size - 1 else l1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - (penalty if z[i] > 0 else -penalty)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(passes):
        for x, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    return {i: weight(i) for x in rows for i in x}


def plain_features(text):
    """{place: value}: words, pairs, and runs of one to three word shapes, over the root of the number of words."""
    mix = lambda a, salt: int(quality._mixed(np.array([a & (1 << 64) - 1], np.uint64), salt)[0])
    shape = lambda w: re.sub(rb"(.)\1+", rb"\1", bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in w), flags=re.S)
    words_ = text.split()
    word, kind, prime = [crc32(w.lower()) for w in words_], [crc32(shape(w), 7) for w in words_], 0x100000001B3
    found: dict = {}
    for i in range(len(words_)):
        places = [mix(word[i], 1), mix(kind[i], 3)]
        if i + 1 < len(words_):
            places += [mix(word[i] * prime + word[i + 1], 2), mix(kind[i] * prime + kind[i + 1], 4)]
        if i + 2 < len(words_):
            places.append(mix((kind[i] * prime + kind[i + 1] & (1 << 64) - 1) * prime + kind[i + 2], 5))
        for p in places:
            found[p] = found.get(p, 0) + 1 / len(words_) ** 0.5
    return found


def test_classifier_by_plain_updates(texts):
    data = [t.encode()[:400] for t in list(texts.values())[:40]] + [b"", b" ", b"one", b"a b"]
    labels = [i * 7 % 3 % 2 for i in range(len(data))]
    size = (1 << quality.BITS) + 2
    rows = [plain_features(t) | {size - 1: 1.0} for t in data]
    want, got = plain_ftrl(rows, labels, size), quality.train(data, labels)
    assert np.allclose([got[i] for i in want], list(want.values()), atol=1e-4)
    assert np.count_nonzero(got) <= len(want)
    scored = [1 / (1 + np.exp(-sum(float(got[i]) * v for i, v in x.items()))) for x in rows]
    assert np.allclose(quality.scores(data, got), scored, atol=1e-6)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    big, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = [r for r in quality.score(big, quality.fit(big, labels)).join(labels, "doc_id").collect() if r.held_out]
    assert all(held_out(r.doc_id) and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_classifiers_bear_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    s = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(s) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in s)
    assert quality.score(odd, quality.fit(odd, labels.limit(0))).filter("score <> 0.5").count() == 0
    p = langid.predict(odd, langid.fit(odd)).collect()
    assert len(p) == len(ODD) + 1 and {r.lang_pred for r in p} <= {"en", "und"}
    assert langid.predict(odd, langid.fit(odd.limit(0))).filter("lang_pred <> 'und'").count() == 0


# 5


def plain_feature(data):
    size = len(data) // 64
    cells = [sum(data[i * size : (i + 1) * size]) for i in range(64)]
    bits = "".join("1" if c * 64 > sum(data) else "0" for c in cells)
    return f"{sum(data) * 1000 // len(data)}:{int(bits, 2):016x}"


def test_media_round_trip(odd):
    forms = {r.doc_id: r.media for r in media.stored(odd).collect()}
    rows = media.digest(media.stored(odd)).collect()
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(ODD):
        data = (t or "").encode()
        whole = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r, form = by[i if i else None], forms[i if i else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), crc32(whole[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(form), hashlib.sha256(form).hexdigest(), plain_feature(whole))


def images_of(texts):
    out = []
    for t in texts:
        pixels = np.frombuffer(media.payload(t.encode()), np.uint8).reshape(-1, 144, 4)
        out += [pixels[at : at + media.TILE_ROWS] for at in range(0, len(pixels), media.TILE_ROWS)]
    return out


def test_stored_images_use_the_format(texts):
    """The stored images hold references, cache hits, palettes and codes of unlike lengths, and are far below their payload."""
    images = images_of(list(texts.values())[:150])
    files = webp_encoder.encode_many(images)
    assert sum(map(len, files)) < 0.6 * sum(x.size for x in images)
    seen = {"copies": 0, "hits": 0, "plain": 0, "palettes": 0, "uneven": 0}
    read, code = webp._read_image, webp._read_code

    def read_code(bits, size):
        own = code(bits, size)
        seen["uneven"] += len(set(own.own.tolist())) > 1
        if size >= 280:
            plain = own.read

            def counted(bits):
                s = plain(bits)
                seen["plain" if s < 256 else "copies" if s < 280 else "hits"] += 1
                return s

            own.read = counted
        return own

    def read_image(bits, width, height, main):
        seen["palettes"] += not main
        return read(bits, width, height, main)

    webp._read_code, webp._read_image = read_code, read_image
    try:
        assert all((webp.decode(f) == x).all() for f, x in zip(files, images, strict=True))
    finally:
        webp._read_code, webp._read_image = code, read
    assert seen["copies"] > 100 and seen["hits"] > 100 and seen["uneven"] > 100 and seen["palettes"] > 0


@pytest.mark.parametrize("kind", ["noise", "text", "few", "runs", "grey", "gradient"])
def test_webp_encoder_by_both_decoders(kind):
    r = np.random.default_rng(5)
    images = []
    for _ in range(25):
        h, w = int(r.integers(1, 30)), int(r.integers(1, 40))
        x = r.integers(0, 256, (h, w, 4), np.uint8)
        if kind == "text":
            x = x % 26 + 97
        elif kind == "few":
            n = int(r.integers(1, 18))
            x = r.integers(0, 256, (n, 4), np.uint8)[r.integers(0, n, (h, w))]
        elif kind == "runs":
            x = np.repeat(x, 9, axis=1)
        elif kind == "grey":
            x = (x[..., :1] + np.array([3, 0, 5, 0])).astype(np.uint8)
        elif kind == "gradient":
            x = (np.arange(h * w * 4).reshape(h, w, 4) // 7).astype(np.uint8)
        images.append(np.ascontiguousarray(x))
    images.append(np.zeros((1, 1, 4), np.uint8))
    files = webp_encoder.encode_many(images)
    assert all((webp.decode(f) == x).all() for f, x in zip(files, images, strict=True))
    assert all((a == b).all() for a, b in zip(webp_lanes.decode_many(files), images, strict=True))
    if kind == "grey":
        assert any(webp.stream_of(f)[5] & 7 == 1 | webp.SUBTRACT_GREEN << 1 for f in files)


def test_huffman_is_optimal_and_bounded():
    import heapq

    r = random.Random(2)
    cases = [[r.choice((1, 1, 2, 5, 40)) for _ in range(r.randint(1, 60))] for _ in range(60)] + [[1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]]
    counts, rows = np.array([c for x in cases for c in x]), np.array([i for i, x in enumerate(cases) for _ in x])
    for limit in (15, 7):
        lengths = webp_encoder.huffman(counts, rows, limit)
        assert lengths.max() <= limit
        for i, x in enumerate(cases):
            own = lengths[rows == i].tolist()
            assert len(x) == 1 and own == [0] or sum(2.0**-n for n in own) == 1
            heap, best = list(x), 0
            heapq.heapify(heap)
            while len(heap) > 1:
                both = heapq.heappop(heap) + heapq.heappop(heap)
                best += both
                heapq.heappush(heap, both)
            assert limit < 15 or sum(n * c for n, c in zip(own, x, strict=True)) == best


def both_decoders(file):
    """The pixels, by the decoder of single images and by that of many."""
    one = webp.decode(file)
    for other in webp_lanes.decode_many([file, file]):
        assert (one == other).all()
    return one


class Writer:
    """A plain encoder, also of the features that webp_encoder doesn't write."""

    def __init__(self):
        self.bits: list[int] = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, size, extra=()):
        """Write a code: 8 bits for each symbol below 256, or the (symbol, length) in extra. Returns what writes a symbol."""
        lengths = [0] * size
        if extra:
            for s, n in extra:
                lengths[s] = n
        else:
            lengths[:256] = [8] * 256
        own = sorted({*lengths})
        depth = max(1, (len(own) - 1).bit_length())
        pad = [x for x in range(16) if x not in own][: (1 << depth) - len(own)]
        used = sorted(own + pad)
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(depth if s in used else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.bits += [int(b) for b in f"{used.index(n):0{depth}b}"]
        table, code, before = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - before
            before, table[s] = n, f"{code:0{n}b}"
            code += 1
        return lambda s: self.bits.extend(map(int, table[s]))

    def image(self, argb, main, cache=0, copies=False):
        """Codes and pixels; with copies, runs become back-references of distance 1."""
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        if main:
            self.put(0, 1)
        size = 280 + (1 << cache if cache else 0)
        green = self.code(size, _even(size)) if copies or cache else self.code(280)
        rest = [self.code(256) for _ in range(3)]
        distance = self.code(40, [(0, 1), (1, 1)])
        at, table = 0, {}
        while at < len(argb):
            p = argb[at]
            run = 1
            while copies and at and at + run <= len(argb) and argb[at + run - 1] == argb[at - 1] and run < 5:
                run += 1
            run -= 1
            if run >= 1:
                green(256 + run - 1)
                distance(1)  # symbol 1 is distance 2: the pixel before
                at += run
                continue
            key = (webp.CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache) if cache else None
            if cache and table.get(key) == p:
                green(280 + key)
            else:
                green(p >> 8 & 255)
                for code, shift in zip(rest, (16, 0, 24), strict=True):
                    code(p >> shift & 255)
            if cache:
                table[key] = p
            at += 1

    def file(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return webp.wrap(np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes())


def _even(size):
    """A complete code over symbols 0 to size - 1 of two neighbouring lengths."""
    depth = (size - 1).bit_length()
    short = (1 << depth) - size
    return [(s, depth - 1 if s < short else depth) for s in range(size)]


def start(width, height):
    w = Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    return w


def pixels_of(argb, width):
    return np.array([[p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24] for p in argb], np.uint8).reshape(-1, width, 4)


@pytest.mark.parametrize(("cache", "copies"), [(0, False), (3, False), (0, True), (5, True)])
def test_webp_references_and_cache(cache, copies):
    r = random.Random(cache)
    pool = [r.getrandbits(32) for _ in range(6)]
    argb = [x for _ in range(60) for x in [r.choice(pool)] * r.randint(1, 6)]
    argb = argb[: len(argb) // 8 * 8]
    w = start(8, len(argb) // 8)
    w.put(0, 1)
    w.image(argb, True, cache, copies)
    assert (both_decoders(w.file()) == pixels_of(argb, 8)).all()


def test_webp_predictors():
    """Each predictor mode by its definition, pixel for pixel."""
    r = random.Random(5)
    width, height = 16, 56  # blocks of 4 x 4: the 14 modes down the image
    want = np.array([[[r.randrange(256) for _ in range(4)] for _ in range(width)] for _ in range(height)], np.int32)

    def guess(y, x):
        if y == 0:
            return want[0, x - 1] if x else np.array([0, 0, 0, 255])
        if x == 0:
            return want[y - 1, 0]
        le, t, c = want[y, x - 1], want[y - 1, x], want[y - 1, x - 1]
        ri = want[y - 1, x + 1] if x + 1 < width else want[y, 0]
        av = lambda a, b: (a + b) // 2
        p = le + t - c
        nearer = le if np.abs(p - le).sum() < np.abs(p - t).sum() else t
        return [
            np.array([0, 0, 0, 255]), le, t, ri, c, av(av(le, ri), t), av(le, c), av(le, t), av(c, t), av(t, ri), av(av(le, c), av(t, ri)), nearer, np.clip(p, 0, 255),
            np.clip(av(le, t) + np.fix((av(le, t) - c) / 2).astype(int), 0, 255),
        ][y // 4]

    rest = [(want[y, x] - guess(y, x)) & 255 for y in range(height) for x in range(width)]
    number = lambda p: int(p[3]) << 24 | int(p[0]) << 16 | int(p[1]) << 8 | int(p[2])
    w = start(width, height)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(0, 3)
    w.image([0xFF000000 | (y // 1) << 8 for y in range(14) for _ in range(4)], False)
    w.put(0, 1)
    w.image([number(p) for p in rest], True)
    assert (both_decoders(w.file()) == want).all()


def test_webp_colour_transforms_and_palette():
    r = random.Random(6)
    argb = [r.getrandbits(32) for _ in range(64)]
    split = lambda p: (p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255)
    join = lambda a, re_, g, b: a << 24 | (re_ & 255) << 16 | (g & 255) << 8 | b & 255
    signed = lambda v: v - 256 if v > 127 else v
    w = start(8, 8)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(0, 1)
    w.image([join(a, x - g, g, b - g) for a, x, g, b in map(split, argb)], True)
    assert (both_decoders(w.file()) == pixels_of(argb, 8)).all()
    to_red, to_blue, red_to_blue = 0x35, 0xC1, 0x90
    delta = lambda f, c: signed(f) * signed(c) >> 5
    w = start(8, 8)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(1, 3)
    w.image([0xFF << 24 | red_to_blue << 16 | to_blue << 8 | to_red], False)
    w.put(0, 1)
    w.image([join(a, x - delta(to_red, g), g, b - delta(to_blue, g) - delta(red_to_blue, x)) for a, x, g, b in map(split, argb)], True)
    assert (both_decoders(w.file()) == pixels_of(argb, 8)).all()
    for n in (2, 3, 9, 40):
        table = [r.getrandbits(32) for _ in range(n)]
        index = [r.randrange(n) for _ in range(7 * 5)]
        shift = webp.packing(n)
        w = start(7, 5)
        w.put(1, 1)
        w.put(webp.PALETTE, 2)
        w.put(n - 1, 8)
        before = [0] + table[:-1]
        w.image([join((a - a0) & 255, x - x0, g - g0, b - b0) for (a, x, g, b), (a0, x0, g0, b0) in zip(map(split, table), map(split, before), strict=True)], False)
        w.put(0, 1)
        each, many = 8 >> shift, 1 << shift
        packed = [sum(index[y * 7 + x + k] << (k * each) for k in range(many) if x + k < 7) << 8 for y in range(5) for x in range(0, 7, many)]
        w.image(packed, True)
        assert (both_decoders(w.file()) == pixels_of([table[i] for i in index], 7)).all()


def test_webp_refuses_other_bytes():
    whole = webp_encoder.encode_many([np.random.default_rng(1).integers(0, 256, (9, 9, 4), np.uint8)])[0]
    short = webp.wrap(webp.stream_of(whole)[:-40])
    for bad in (b"", b"RIFF" + bytes(40), whole[:-9], short):
        with pytest.raises(webp.BadStream):
            webp_lanes.decode_many([bad])
        with pytest.raises(webp.BadStream):
            webp.decode(bad)


# 6


def smallest_capacity(sizes, shards):
    def needed(c):
        n, room = 1, c
        for x in sizes:
            if x > room:
                n, room = n + 1, c
            room -= x
        return n

    c = max(max(sizes), -(-sum(sizes) // shards))
    while needed(c) > shards:
        c += 1
    return c


@pytest.mark.parametrize(("n", "shards", "first"), [(1, 40, 4), (30, 7, 4), (900, 40, 4), (900, 40, 1), (400, 3, 1)])
def test_minimax_is_exact(spark, n, shards, first, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", first)
    monkeypatch.setattr(sharding, "DIGITS", first)
    r = random.Random(n)
    groups = sorted((hashlib.md5(str(i).encode()).hexdigest(), r.choice((20, 50, 3000)) if i else 9000) for i in range(n))
    capacity, cuts = sharding.minimax(spark.createDataFrame(groups, "gkey string, size long"), shards)
    assert capacity == smallest_capacity([s for _, s in groups], shards)
    load = [0] * shards
    for k, s in groups:
        load[sum(c <= k for c in cuts)] += s
    assert max(load) <= capacity


def test_shards(odd, docs):
    for d in (odd, docs):
        rows = sharding.assign(d, bucket_rows=2).collect()
        assert len(rows) == d.count()
        slots: dict = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) < 40
        # Sizes and checksums by their definition, equal texts together, and the least possible largest shard.
        size = lambda t: len((t or "").encode()) + 16
        want = sorted((str(r.doc_id), size(r.text), crc32((r.text or "").encode())) for r in d.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
        assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
        groups: dict = {}
        for r in d.select("text").collect():
            key = hashlib.md5((r.text or "").encode()).hexdigest()
            groups[key] = groups.get(key, 0) + size(r.text)
        load: dict = {}
        for r in rows:
            load[r.shard] = load.get(r.shard, 0) + r.size
        assert max(load.values()) <= smallest_capacity([groups[k] for k in sorted(groups)], 40)
        shards = {r.text: set() for r in d.select("text").collect()}
        by_id = {r.doc_id: r.shard for r in rows}
        for r in d.select("doc_id", "text").collect():
            shards[r.text].add(by_id[r.doc_id])
        assert all(len(x) == 1 for x in shards.values())
    assert sharding.assign(odd.limit(0)).count() == 0


# 8


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokencount.VOCABULARY))


def test_token_counts(odd, texts):
    own = library()
    want = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    rows = tokencount.count(odd).collect()
    assert {(r.doc_id, r.n_tokens) for r in rows} == {(i if i else None, want(t or "")) for i, t in enumerate(ODD)}
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert tokencount.counter().count(list(texts.values())) == [want(t) for t in texts.values()]


PARTS = ["abc", "Ünï", " ", "\n", "\x1c", "\x85", "\u0301", "İ", "Σ", "<|endoftext|>", "12", "²", "中文", "'S", "　", "ﬃ", "x" * 50]


def spliced_alike(own, least=0, rounds=800, **sizes):
    """A counter of small chunks gives the whole texts' counts; how often an alignment failed."""
    r, small = random.Random(1), tokencount.Counter(own, **sizes)
    for _ in range(rounds):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 60)))
        assert small.count([t, t]) == [len(own.encode(t, add_special_tokens=False).ids)] * 2
    return small


def test_overlaps_widen():
    small = spliced_alike(library(), chunk=40, overlap=4)
    assert small.separators and small.widened > 100
    # The first overlap lies in one word, so that the encodings disagree there.
    own, text = library(), "some words " * 5 + "x" * 90 + " and more words of the text" * 5
    small = tokencount.Counter(own, chunk=100, overlap=8)
    assert small.count([text]) == [len(own.encode(text, add_special_tokens=False).ids)] and small.widened > 0


def test_tokens_across_white_space():
    """Tokenizers whose tokens cross white space, or only some of it, have fewer separators or none."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = {c: i for i, c in enumerate(dict.fromkeys("".join((*PARTS, *tokencount.PROBES)) + tokencount.WHITE_SPACE))}
    vocabulary = letters | {"c ": 1000, "c a": 1001, "c\n": 1002}
    crossing = Tokenizer(models.BPE(vocabulary, [("c", " "), ("c ", "a"), ("c", "\n")]))
    assert spliced_alike(crossing, rounds=200, chunk=40, overlap=4).separators == ""
    lines = Tokenizer(models.BPE(vocabulary, [("c", " "), ("c ", "a")]))
    lines.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
    assert spliced_alike(lines, rounds=200, chunk=40, overlap=4).separators == "\n"
    lstrip = library()
    lstrip.add_special_tokens([__import__("tokenizers").AddedToken("<x>", lstrip=True)])
    assert tokencount.separators(lstrip) == ""
    assert spliced_alike(lstrip, rounds=200, chunk=40, overlap=4).widened == 0


# 9


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    a = np.array(values, np.uint64)
    parent = list(range(len(a)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4):
            parent[find(int(j))] = find(i)
    return [find(i) for i in range(len(a))]


def test_simhash(docs, odd, texts):
    rows = simhash.components(docs).collect()
    ids = sorted(texts)
    fps = {i: plain_fingerprint(texts[i]) for i in ids}
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" for r in rows)
    groups: dict = {}
    for i, g in zip(ids, plain_components([fps[i] for i in ids]), strict=True):
        groups.setdefault(g, []).append(i)
    want = {i: min(own) for own in groups.values() for i in own}
    assert {r.doc_id: r.component_id for r in rows} == want
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, {t for t in ODD if (t or "").strip()} | {""}))
    assert simhash.components(odd).count() == odd.count() and simhash.components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [64, 4])
def test_links_by_brute_force(spark, crowd):
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(50)}
    for b in sorted(values)[:12]:
        for _ in range(r.choice((3, 120))):
            x = b
            for _ in range(r.randint(1, 6)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {x.node: x.root for x in simhash.spread(simhash.links(nodes, crowd=crowd)).collect()}
    want: dict = {}
    for v, g in zip(signed, plain_components(values), strict=True):
        want.setdefault(g, set()).add(v)
    got: dict = {}
    for v in signed:
        got.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# 10


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(codec, text):
    return [i for part in codec.encode(text) for i in part.tolist()]


def test_bpe(odd, texts):
    want, own, r = tiktoken_encoding(), bpe.codec(), random.Random(1)
    alphabet = "abc  \n\t'sdlA1²½٣éü中文😀_-.,!\x1c\x85  İΣ́"
    cases = list(texts.values()) + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["a" * 3000, "=" * 3000, " " * 500]
    for t in cases:
        ids = want.encode_ordinary(t)
        assert encoded(own, t) == ids and own.decoder.decode(ids) == t
    rows = {x.doc_id: x for x in bpe.encode_digest(odd).collect()}
    for i, t in enumerate(ODD):
        ids = want.encode_ordinary(t or "")
        x = rows[i if i else None]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256, x.decoded_chars) == (len(ids), digest(" ".join(map(str, ids))), digest(t or ""), len(t or ""))
    assert {x.text for x in bpe.decode(bpe.encode(odd)).collect()} == {t or "" for t in ODD}


def test_transducer_restarts():
    want, codec = tiktoken_encoding(), bpe.codec()
    small = bpe.Transducer(codec.ranks, limit=50)
    for i in range(3000):
        t = "thequickbrownfoxjumpsoverthelazydog"[i % 30 :] * (1 + i % 4)
        assert small.encode(t.encode()) == want.encode_ordinary(t)
    assert len(small.states) <= 50 and small.unmade < 2600  # it began anew


def test_tokens_are_settled_after_bounded_lookahead():
    machine = bpe.Transducer(bpe.codec().ranks)
    machine.encode(b"thequickbrownfoxjumpsoverthelazydog" * 20)
    assert max(len(pending) for _, pending, _, _ in machine.states) < 30


def test_pairs_by_brute_force():
    machine, r = bpe.codec().machine, random.Random(3)
    short = [i for i, b in machine.bytes_of.items() if len(b) < 6]
    followers = [(machine.ranks[b[:k]], machine.ranks[b[k:]]) for b in list(machine.ranks)[:9000] for k in range(1, len(b)) if b[:k] in machine.ranks and b[k:] in machine.ranks]
    pairs = [(r.choice(short), r.choice(short)) for _ in range(4000)] + r.sample(followers, 4000)
    for a, b in pairs:
        assert machine.fit(a, b) == (machine.merged(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b])
    # Ranks that no training gives: parts above their whole, and runs of one byte.
    odd = bpe.Transducer({b"a": 9, b"b": 5, b"aa": 3, b"ab": 2, b"aaa": 1, b"aab": 4, b"ba": 7, b"aaaa": 0})
    for n in range(1, 9):
        for k in range(2**n):
            data = bytes(97 + (k >> i & 1) for i in range(n))
            assert b"".join(odd.bytes_of[i] for i in odd.encode(data)) == data and odd.encode(data) == odd.merged(data)


def test_windows_dont_show():
    own, text = bpe.codec(), "Was it 12 o'clock, or  not?\n Então 中文 " * 40
    small = bpe.Codec(__import__("public_tokenizers").path(bpe.VOCABULARY), window=7)
    assert encoded(small, text) == encoded(own, text) and small.digests(text) == own.digests(text) and len(list(small.windows(text))) > 50


def test_decoder_holds_cut_characters():
    decoder = bpe.TokenDecoder([b"a\xf0", b"\x9f\x98", b"\x80", b"z", b"\xc3\xa9\xe4"])
    assert decoder.decode([3, 0, 1, 2, 3]) == "za😀z"
    assert decoder.decode([4, 3, 0]) == "é�za�" and decoder.decode([]) == ""


def test_utf8_stream():
    text = "aé中😀z" * 3
    for step in (1, 2, 3, 5):
        s, data = bpe.Utf8Stream(), text.encode()
        assert "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.close() == text
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xe4\xb8") == "a" and s.close() == "�"

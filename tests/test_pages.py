"""Normalisation, running lines and the chunker, on small cases."""

import hashlib
import random
import re
import uuid

import pytest

from pagemill.operators import pages
from pagemill.settings import Chunking, Normalization


@pytest.mark.parametrize(
    ("source", "made"),
    [
        ("hello \t\n  world", "hello\n world"), ("a  b\n c", "a b\n c"), ("tele-\nphone line", "telephone line"), ("word-\n\nline", "word-\nline"), ("word-\nLine", "word-\nLine"),
        ("word-", "word-"), ("a\nb", "a b"), ("\na", "\na"), ("a\n", "a\n"), ("a \n\n b", "a\nb"), ("1-\nb", "1-\nb"), ("ab- \t\ncd", "abcd"), ("ab-\n cd", "ab-\n cd"), ("", ""),
    ],
)
def test_normalize(source, made):
    text, spans = pages.normalize(source, [])
    assert text == made
    for c, (a, b) in zip(text, spans, strict=True):
        assert source[a:b].strip() == "" if c.isspace() else source[a:b] == c


def test_switches():
    assert pages.normalize("tele-\nphone", [], Normalization(collapse_whitespace=False))[0] == "tele-\nphone"
    assert pages.normalize("word-\nline", [], Normalization(dehyphenate=False))[0] == "word-\nline"


def cleaned(spark, texts):
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book string, position int, text string")
    return [r.searchable for r in pages.normalized(pages.removed_ranges(df)).orderBy("position").collect()]


def test_running_lines(spark):
    assert cleaned(spark, ["The Tale\nbody one", "The Tale\nbody two", "Other\nbody three"]) == ["body one", "body two", "Other body three"]
    assert cleaned(spark, ["body one\nfoot", "body two\nfoot"]) == ["body one\n", "body two\n"]
    assert cleaned(spark, ["7\nalpha", "7\nbeta"]) == ["7 alpha", "7 beta"]
    assert cleaned(spark, ["The Tale\nbody"]) == ["The Tale body"]
    assert cleaned(spark, ["same", "same", ""]) == ["", "", ""]


def cut(texts, s, titles=None):
    own, out = pages.Chunker("run", s), []
    for i, t in enumerate(texts):
        out += own.feed(f"u{i}", t, [[0, len(t), 0, len(t)]] if t else [], titles[i] if titles else None)
    return out + list(own.close())


def reference_cut(texts, s):
    """Token texts of each chunk, by the rule over the whole stream."""
    stream = [(w, k == len(ws) - 1) for t in texts for ws in [t.split()] for k, w in enumerate(ws)]
    out, i = [], 0
    while i < len(stream):
        c = min(len(stream), i + max(1, min(s.target, s.maximum)))
        if c < len(stream):
            low = max(i, c - max(20, s.target // 4))
            c = next((k + 1 for k in range(c - 1, low - 1, -1) if stream[k][1]), c)
        out.append(" ".join(w for w, _ in stream[i:c]))
        if c >= len(stream):
            break
        i = c - s.overlap if c - s.overlap > i else i + 1
    return out


@pytest.mark.parametrize(("target", "overlap"), [(5, 2), (30, 5), (600, 100), (3, 3)])
def test_chunks_follow_the_rule(target, overlap):
    texts = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((0, 1, 7, 45, 3, 120))]
    s = Chunking(target, overlap)
    made = cut(texts, s)
    assert [c["text"] for c in made] == reference_cut(texts, s)
    assert [c["position"] for c in made] == list(range(len(made)))
    assert len({c["chunk_id"] for c in made}) == len(made)


def test_title_takes_budget():
    made = cut(["a b c d e f"], Chunking(4, 0), ["My Title"])
    assert [(c["text"], c["title"], c["token_count"]) for c in made] == [("a b", "My Title", 4), ("c d e f", None, 4)]
    assert cut([""], Chunking()) == []


def test_spans_quote_the_source():
    text = "one two three"
    (c,) = cut([text], Chunking())
    (s,) = c["spans"]
    assert text[s["source_start"] : s["source_end"]] == text


def plain_normalize(text, removed):
    """The definition character by character: (made character, source start, source end)."""
    out, at, n = [], 0, len(text)
    inside = lambda i: next((b for a, b in removed if a <= i < b), None)
    while at < n:
        if (end := inside(at)) is not None:
            at = end
            continue
        if text[at] == "-" and at and text[at - 1].isalpha():
            k = at + 1
            while k < n and text[k] in " \t":
                k += 1
            if k + 1 < n and text[k] == "\n" and text[k + 1] != "\n" and text[k + 1].islower():
                at = k + 1
                continue
        if not text[at].isspace():
            out.append((text[at], at, at + 1))
            at += 1
            continue
        end = at
        while end < n and text[end].isspace():
            end += 1
        breaks = text.count("\n", at, end)
        if breaks == 0:
            made = " "
        elif breaks > 1:
            made = "\n"
        elif text[end - 1] != "\n":
            made = "\n "
        else:
            made = "\n" if at == 0 or end == n or text[at - 1] == "-" or inside(end) is not None else " "
        out += [(c, at, end) for c in made]
        at = end
    return out


def test_normalize_by_characters():
    r = random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice(["a", "B", "é", "-", " ", "  ", "\n", "\t", "\u00a0", ".", "-\n", "\n "]) for _ in range(r.randint(0, 30)))
        cuts = sorted(r.sample(range(len(text) + 1), 4)) if len(text) > 4 and r.random() < 0.5 else []
        removed = list(zip(cuts[::2], cuts[1::2], strict=True))
        made, spans = pages.normalize(text, removed)
        want = plain_normalize(text, removed)
        assert (made, spans) == ("".join(c for c, _, _ in want), [(a, b) for _, a, b in want]), (text, removed)


def test_spans_of_tokens_by_characters():
    r = random.Random(6)
    for _ in range(300):
        texts = ["".join(r.choice(["ab", "c-\nd", " ", "  ", "\n", "\n\n", " \n x", "e"]) for _ in range(r.randint(0, 25))) for _ in range(3)]
        own, made = pages.Chunker("run", Chunking(4, 1)), []
        by_unit = {}
        for i, t in enumerate(texts):
            searchable, runs = pages.normalize_runs(t, [])
            spans = pages.expanded(runs)
            by_unit[f"u{i}"] = [(m[0], spans[m.start()][0], spans[m.end() - 1][1]) for m in re.finditer(r"\S+", searchable)]
            made += own.feed(f"u{i}", searchable, runs, None)
        made += own.close()
        for c in made:
            words, at = c["text"].split(" "), 0
            for s in c["spans"]:
                tokens = by_unit[s["unit_id"]]
                k = next(k for k, x in enumerate(tokens) if x[0] == words[at] and x[1] == s["source_start"])
                n = next(n for n in range(1, len(tokens) - k + 1) if max(x[2] for x in tokens[k : k + n]) == s["source_end"] and (at + n == len(words) or k + n == len(tokens)))
                assert [x[0] for x in tokens[k : k + n]] == words[at : at + n]
                at += n
            assert at == len(words)


def test_word_boxes():
    places = pages.word_places("to be or to", [("to", [0, 0, 2, 1]), ("gone", [9, 9, 9, 9]), ("or", [5, 0, 2, 3.00049]), ("to", [8, 1, 2, 1])])
    assert [(a, b) for a, b, _ in places] == [(0, 2), (6, 8), (9, 11)]
    assert pages.union_box(places, 5, 20) == [5, 0, 10, 3.0] and pages.union_box(places, 3, 6) is None
    own = pages.Chunker("run", Chunking(2, 0))
    made = [*own.feed("u", "to be or to", [[0, 11, 0, 11]], None, [("to", [0, 0, 2, 1]), ("be", [3, 0, 2, 1]), ("to", [8, 1, 2, 1])]), *own.close()]
    assert [c["spans"][0]["bbox"] for c in made] == [[0, 0, 5, 1], [8, 1, 10, 2]]


def test_chunk_ids_are_the_registry_ones():
    assert Chunking().sha() == hashlib.sha256(b'{"max_tokens": 2048, "overlap_tokens": 100, "target_tokens": 600, "title_prefix": true, "tokenizer": "words", "tokenizer_path": null}').hexdigest()
    (c,) = cut(["one two"], Chunking())
    signature, text = (hashlib.sha256(x).hexdigest() for x in (b'[["u0",0,7]]', b"one two"))
    name = f"chunk:run:{Chunking().sha()}:{signature}:{text}"
    assert c["chunk_id"] == str(uuid.uuid5(uuid.UUID("8f3e2a10-0000-4000-8000-0000000000d6"), name))

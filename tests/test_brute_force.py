"""Queries that SQL can't express, on whole tables against plain Python versions of their definitions."""

import hashlib
import html
import json
import math
import re
import uuid
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from test_pages import plain_normalize

from pagemill.operators import jobs
from pagemill.plans import catalogue
from pagemill.plans.reporting import job_events
from pagemill.settings import Chunking, Embedding, Search


@pytest.fixture(scope="module")
def tables(sf_dir):
    return {t: pq.read_table(f"{sf_dir}/{t}.parquet").to_pylist() for t in ("documents", "benchmark", "labels", "embeddings", "pages")}


def rows(spark, sf_dir, name):
    return [r.asDict(recursive=True) for r in catalogue.QUERIES[name](spark, sf_dir).collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def made(tables):
    """By book, in order: (position, made characters with their source ranges), running lines cut out."""
    books = defaultdict(list)
    for d in sorted(tables["documents"], key=lambda d: d["doc_id"]):
        books[d["source"]].append((d["doc_id"], d["text"] or ""))
    out = {}
    for book, own in books.items():
        edges = {}
        for i, t in own:
            lines = t.split("\n")
            lines = lines[:-1] if len(lines) > 1 and lines[-1] == "" else lines
            edges[i] = (lines[0].strip(), lines[-1].strip(), min(len(lines[0]) + 1, len(t)), len("\n".join(lines)) - len(lines[-1]))
        first, last = (Counter(e[k] for e in edges.values() if 3 <= len(e[k]) <= 80) for k in (0, 1))
        out[book] = []
        for i, t in own:
            e = edges[i]
            removed = ([(0, e[2])] if first[e[0]] >= 2 else []) + ([(e[3], len(t))] if last[e[1]] >= 2 else [])
            out[book].append((i, plain_normalize(t, removed)))
    return out


def test_normalize_text(spark, sf_dir, made):
    want = {i: (book, sha("".join(c for c, _, _ in chars)), len(chars)) for book, own in made.items() for i, chars in own}
    got = {r["position"]: (r["book"], r["sha256"], r["n_chars"]) for r in rows(spark, sf_dir, "normalize_text")}
    assert got == want


def plain_chunks(book, pages, s):
    stream = []
    for position, chars in pages:
        text = "".join(c for c, _, _ in chars)
        found = list(re.finditer(r"\S+", text))
        for k, m in enumerate(found):
            stream.append((m[0], f"{book}:{position}", chars[m.start()][1], chars[m.end() - 1][2], k == len(found) - 1 or text[m.end()] == "\n"))
    i, out = 0, []
    while i < len(stream):
        c = min(len(stream), i + s.target)
        if c < len(stream):
            c = next((k + 1 for k in range(c - 1, max(i, c - max(20, s.target // 4)) - 1, -1) if stream[k][4]), c)
        spans = []
        for _, unit, a, b, _ in stream[i:c]:
            if spans and spans[-1][0] == unit:
                spans[-1][2] = max(spans[-1][2], b)
            else:
                spans.append([unit, a, b])
        text = " ".join(t[0] for t in stream[i:c])
        name = f"chunk:{book}:{s.sha()}:{sha(json.dumps(spans, separators=(',', ':')))}:{sha(text)}"
        out.append((book, len(out), str(uuid.uuid5(uuid.UUID("8f3e2a10-0000-4000-8000-0000000000d6"), name)), c - i, sha(text), len(spans)))
        if c >= len(stream):
            break
        i = c - s.overlap if c - s.overlap > i else i + 1
    return out


def test_chunks_and_links(spark, sf_dir, made):
    want = sorted(c for book, pages in made.items() for c in plain_chunks(book, pages, Chunking(256, 40)))
    got = sorted(tuple(r[k] for k in ("book", "position", "chunk_id", "token_count", "text_sha256", "n_units")) for r in rows(spark, sf_dir, "chunk_documents"))
    assert got == want
    ids = {(b, p): c for b, p, c, *_ in want}
    for r in rows(spark, sf_dir, "chunk_links"):
        at = (r["book"], r["position"])
        assert (ids[at], ids.get((at[0], at[1] - 1)), ids.get((at[0], at[1] + 1))) == (r["chunk_id"], r["prev_chunk_id"], r["next_chunk_id"])


def test_page_texts(spark, sf_dir, tables):
    def text(page):
        bare = re.sub(r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", page)
        bare = re.sub(r"&(lt|gt|quot|#39|nbsp|amp);", lambda m: html.unescape(m[0]).replace("\xa0", " "), bare)
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", bare).strip(" ")

    want = {p["page_id"]: len(text(p["html"])) for p in tables["pages"]}
    assert {r["page_id"]: r["n_chars"] for r in rows(spark, sf_dir, "page_texts")} == want


def test_job_fold(spark, sf_dir):
    events = defaultdict(list)
    for e in job_events(spark, sf_dir).collect():
        events[e.job_id].append((e["at"], e.seq, e.kind, e.token, e.transient, e.detail))
    want = {}
    for job, own in events.items():
        state = jobs.State()
        for at, _, kind, token, transient, detail in sorted(own):
            state = jobs.apply(state, kind, at, token, transient, detail)
        want[job] = vars(state)
    got = {r.pop("job_id"): r for r in rows(spark, sf_dir, "job_fold")}
    assert got == want


class Library:
    """Search by its definition, one query after the other."""

    def __init__(self, tables, only=None):
        self.docs = {d["doc_id"]: d for d in tables["documents"]}
        self.labels = {r["doc_id"]: r for r in tables["labels"]}
        self.vectors = {e["vec_id"]: e["embedding"] for e in tables["embeddings"]}
        self.questions = {q["item_id"]: q["text"] for q in tables["benchmark"]}
        self.only = only

    def sparse(self, text, pool):
        tokens = {i: Counter(self.docs[i]["text"].lower().split()) for i in pool}
        sizes = {i: sum(t.values()) for i, t in tokens.items()}
        n, mean = len(pool), sum(sizes.values()) / max(1, len(pool))
        df = Counter(t for own in tokens.values() for t in own)
        asked = Counter(text.lower().split())

        def weight(tf, size, term):
            return math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))

        scores = {i: round(sum(weight(own[t], sizes[i], t) * weight(k, sum(asked.values()), t) for t, k in asked.items() if t in own), 6) for i, own in tokens.items()}
        return [i for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])) if s]

    def dense(self, query, pool):
        scores = {i: round(sum(float(a) * float(b) for a, b in zip(query, self.vectors[i], strict=True)), 6) for i in pool if i in self.vectors}
        return sorted(scores, key=lambda i: (-scores[i], i))

    def search(self, number, lists, valid, diversify=True, s=Search()):
        limit, before = 60, None
        for round_ in (1, 2, 3):
            rrf = defaultdict(float)
            for own in lists:
                for rank, i in enumerate(own[:limit], 1):
                    rrf[i] += 1 / (60 + rank)
            fused = sorted(rrf, key=lambda i: (-round(rrf[i], 9), i))
            good = [i for i in fused if valid(i)]
            if len(good) >= s.min_passages or limit >= 240 or round_ == 3 or before == len(fused):
                break
            before, limit = len(fused), min(240, 2 * limit)
        chosen, later, used = [], [], 0
        size = lambda i: len(self.docs[i]["text"].split())
        for i in good[:80]:
            if len(chosen) < 12 and used + size(i) <= 6000:
                if diversify and sum(self.docs[c]["source"] == self.docs[i]["source"] for c in chosen) >= 4:
                    later.append(i)
                    continue
                chosen.append(i)
                used += size(i)
        for i in later:
            if len(chosen) < 8 and used + size(i) <= 6000:
                chosen.append(i)
                used += size(i)
        return {"chosen": chosen, "fused": len(fused), "validated": len(good), "limit": limit, "round": round_, "used": used, "sides": [min(limit, len(x)) for x in lists]}


def test_select_passages_and_counts(spark, sf_dir, tables):
    lib, every = Library(tables), sorted(d["doc_id"] for d in tables["documents"])
    bad = {i for i, r in lib.labels.items() if r["quality"] == 0}
    want, counts = {}, {}
    for q, text in lib.questions.items():
        lists = [lib.sparse(text, every)] + ([lib.dense(lib.vectors[q], sorted(lib.vectors))] if q in lib.vectors else [])
        r = lib.search(q, [x[:240] for x in lists], lambda i: i in lib.docs and i not in bad)
        want |= {(q, i): place for place, i in enumerate(r["chosen"], 1)}
        counts[q] = (r["limit"], r["fused"], r["validated"], min(80, r["validated"]), len(r["chosen"]), r["used"])
    assert {(r["query_id"], r["chunk_id"]): r["place"] for r in rows(spark, sf_dir, "select_passages")} == want
    got = {r["query_id"]: tuple(r[k] for k in ("limit", "candidates", "valid", "reranked", "selected", "tokens")) for r in rows(spark, sf_dir, "search_counts")}
    assert got == counts


@pytest.mark.parametrize("dense", [True, False])
def test_search(spark, sf_dir, tables, dense):
    lib = Library(tables)
    active = {i for i, r in lib.labels.items() if r["quality"] == 1}
    pool = [sorted(i for i in lib.docs if i in active and int(lib.docs[i]["source"][3:]) % 2 == e) for e in (0, 1)]
    valid = lambda i: lib.labels.get(i, {"toxic": 0})["toxic"] == 0
    want, places = {}, {}
    for q, text in lib.questions.items():
        if dense and q not in lib.vectors:
            continue
        lists = [lib.sparse(text, p)[:240] for p in pool] + ([lib.dense(lib.vectors[q], pool[0] + pool[1])[:240]] if dense else [])
        r = lib.search(q, lists, valid)
        places |= {(q, i): place for place, i in enumerate(r["chosen"], 1)}
        n_dense = r["sides"][2] if dense else 0
        want[q] = (n_dense, sum(r["sides"][:2]), r["fused"], r["validated"], r["fused"] - r["validated"], min(80, r["validated"]), len(r["chosen"]), r["round"] - 1)
    names = ("dense", "sparse", "fused", "validated", "postvalidation_removed", "reranked", "selected", "topup_rounds")
    got = rows(spark, sf_dir, "search_report" if dense else "search_degraded")
    assert {r["query_id"]: tuple(r[k] for k in names) for r in got} == want
    assert {(r["degraded"], r["degraded_reason"]) for r in got} == ({(False, None)} if dense else {(True, "embedding model not configured; sparse-only search")})
    if dense:
        assert {(r["query_id"], r["chunk_id"]): r["place"] for r in rows(spark, sf_dir, "search_passages")} == places


def test_search_in_one_book(spark, sf_dir, tables):
    lib = Library(tables)
    pool = [sorted(i for i, r in lib.labels.items() if r["quality"] == 1 and lib.docs[i]["source"] == "src1")]
    valid = lambda i: lib.labels[i]["toxic"] == 0
    want = {(q, i) for q, text in lib.questions.items() for i in lib.search(q, [lib.sparse(text, pool[0])], valid, diversify=False)["chosen"]}
    assert {(r["query_id"], r["chunk_id"]) for r in rows(spark, sf_dir, "search_one_book")} == want


def test_index_points(spark, sf_dir, tables):
    space = lambda d: uuid.UUID(f"8f3e2a10-0000-4000-8000-0000000000{d}")
    emb = hashlib.sha256(b'{"dimensions":64,"dtype":"float32","model_name":"rev-1","model_revision":"rev-1","normalize":true}').hexdigest()
    assert Embedding("rev-1", dimensions=64).sha() == emb
    docs = {d["doc_id"]: d for d in tables["documents"]}
    tokens = {i: Counter((d["text"] or "").lower().split()) for i, d in docs.items()}
    df, n = Counter(t for own in tokens.values() for t in own), len(docs)
    mean = sum(sum(t.values()) for t in tokens.values()) / n
    want = {}
    for e in tables["embeddings"]:
        i = e["vec_id"]
        if i not in docs:
            continue
        gen = uuid.uuid5(space("d7"), f"gen:{docs[i]['source']}:{emb}:stats-1")
        size = sum(tokens[i].values())
        weight = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean)) for t, tf in tokens[i].items())
        want[str(i)] = (str(uuid.uuid5(space("d8"), f"point:{i}:{gen}")), str(gen), str(uuid.uuid5(space("d7"), f"pub:{i}:{gen}")), 64, len(tokens[i]), weight)
    got = {r["chunk_id"]: (r["point_id"], r["gen_id"], r["pub_id"], r["dims"], r["terms"], r["weight"]) for r in rows(spark, sf_dir, "index_points")}
    assert got.keys() == want.keys() and all(got[i][:5] == want[i][:5] and abs(got[i][5] - want[i][5]) < 1e-3 for i in want)

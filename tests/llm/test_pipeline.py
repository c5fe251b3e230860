"""The pipeline against a plain version of its stages, and its contract."""
from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
import xxhash

import corpus_pipeline
from stallkeeper.llm import simhash, toxicity

SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_lines(docs):
    words = lambda x: " ".join(x.lower().split())
    lines = sorted((d["doc_id"], k, words(x)) for d in docs for k, x in enumerate(d["text"].split("\n")) if words(x))
    sets = {t: {t[i:i + 8] for i in range(max(1, len(t) - 7))} for t in {x[2] for x in lines}}
    inverse = defaultdict(list)
    for t, s in sets.items():
        for x in s:
            inverse[x].append(t)
    union = Union()
    for t, s in sets.items():
        for u, both in Counter(u for x in s for u in inverse[x] if u > t).items():
            if both / (len(s) + len(sets[u]) - both) >= 0.8:
                union.join(t, u)
    seen, gone = set(), defaultdict(set)
    for doc, k, t in lines:
        root = union.find(t)
        if root in seen:
            gone[doc].add(k)
        seen.add(root)
    out = []
    for d in docs:
        kept = [x for k, x in enumerate(d["text"].split("\n")) if k not in gone[d["doc_id"]]]
        if not gone[d["doc_id"]] or any(words(x) for x in kept):
            out.append(d | {"text": "\n".join(kept)})
    return out


def plain_simhash(docs):
    """All pairs of distinct texts by the same bits, without blocks."""
    prints, ids = {}, defaultdict(list)
    for d in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", d["text"].encode().lower())
        shingles = {xxhash.xxh64_intdigest(b" ".join(w[i:i + 5]), 42) for i in range(max(1, len(w) - 4))} if w else set()
        ids[tuple(w)].append(d["doc_id"])
        prints[tuple(w)] = simhash.wide(list(shingles), simhash.VERIFY // 64)
    union, texts = Union(), list(prints)
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            if np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash.bound(0.8):
                union.join(min(ids[a]), min(ids[b]))
    return [d for d in docs if any(d["doc_id"] == min(x) == union.find(min(x)) for x in ids.values())]


def plain_mix(docs, quality):
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs}
    total = Counter()
    for d in docs:
        total[d["source"]] += size[d["doc_id"]]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    capped, words = set(), 1.5 * sum(total.values())
    while True:
        rate = (words - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in total if s not in capped)
        more = {s for s in total if weight[s] * rate > 2 * total[s]}
        if more <= capped:
            break
        capped |= more
    out = []
    for s in total:
        target = 2 * total[s] if s in capped else weight[s] * rate
        epochs = math.floor(target / total[s])
        rest = math.floor(target) - epochs * total[s]

        def key(d):
            x = int(hashlib.md5(f"{d['doc_id']}:7".encode()).hexdigest()[:13], 16)
            return -math.log((x + 0.5) / 2 ** 52) / {1: 4.0, 0: 1.0}.get(quality.get(d["doc_id"]), 2.0)

        for d in sorted((d for d in docs if d["source"] == s), key=lambda d: (key(d), d["doc_id"])):
            part = max(0, min(size[d["doc_id"]], rest))
            rest -= size[d["doc_id"]]
            taken = epochs * size[d["doc_id"]] + part
            out += [d] * (math.ceil(taken / size[d["doc_id"]]) if taken else 0)
    return out


def test_run_equals_the_plain_stages(spark, documents, labels):
    model = toxicity.train(documents, labels)
    docs = [r.asDict() for r in documents.collect() if model.score(r["text"]) < toxicity.THRESHOLD]
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    docs = plain_mix(plain_simhash(plain_lines(docs)), quality)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d in docs:
        ids = np.array(bpe.encode_ordinary(d["text"]), "<u4").tobytes()
        want[d["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, make_docs):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for docs in (odd, make_docs([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_near_copies_by_similarity(spark, make_docs):
    """Texts of 400 words with some words changed: nearly all at a similarity of 0.85 and more are found, none at 0.5."""
    rng = np.random.RandomState(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    rows, similarity = [], {}
    for k in range(120):
        base = [word() for _ in range(400)]
        copy = list(base)
        for at in rng.choice(400, (2, 4, 6, 40)[k % 4], replace=False):
            copy[at] = word()
        a, b = ({tuple(w[i:i + 5]) for i in range(396)} for w in (base, copy))
        similarity[k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    kept = {r["doc_id"] for r in simhash.keep_one(make_docs(rows)).collect()}
    assert {2 * k for k in range(120)} <= kept
    caught = lambda lo, hi: [2 * k + 1 not in kept for k, s in similarity.items() if lo <= s < hi]
    assert np.mean(caught(0.92, 1.01)) == 1.0 and np.mean(caught(0.85, 0.92)) > 0.9 and not any(caught(0, 0.5))


def test_one_of_a_large_group_of_near_copies(spark, make_docs):
    """More near copies than a tile holds, all amid unrelated texts, and copies without an id."""
    rng = np.random.RandomState(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    base = list(rng.choice(words, 300))
    rows = [(10 + i, " ".join(base[:7 + i % 280] + [f"x{i}"] + base[8 + i % 280:])) for i in range(700)]
    rows += [(2000 + i, " ".join(rng.choice(words, 200))) for i in range(50)] + [(None, " ".join(base)), (3, rows[5][1]), (3, rows[5][1])]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(make_docs(rows)).collect())
    assert kept == [3, *range(2000, 2050)]

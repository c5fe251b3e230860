"""Suffix dedup against a plain table of all windows, its SQL twin, and odd rows."""
from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import queries, suffixes as S
from stallkeeper.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def plain(texts, length=S.LENGTH):
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(d)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(docs, **how):
    rows = docs.collect()
    want = Counter((r["doc_id"], *p) for r, p in zip(rows, plain([r["text"] for r in rows])))
    got = Counter(tuple(r) for r in S.report(docs, **how).collect())
    assert got == want
    return want


def test_whole_table(spark, documents):
    want = check(documents)
    assert sum(n for (_, _, n, _, _), k in want.items() for _ in range(k)) > 1000


def test_sql_twin(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.sql(queries.oracle_sql()["op11_suffixes"]).fetchall()
    assert sorted(map(tuple, queries.op11_suffixes(spark, SF).collect())) == sorted(sql)


def _texts(seed):
    """Shared passages of many lengths at many places, with few symbols, so that anchors crowd and orders are deep."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab é") for _ in range(rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(n)) for n in (30, 45, 60, 90, 200)]
    texts = ["".join(rng.choice([word(), word() * 3, rng.choice(passages)[:rng.randrange(150, 900)]])
                     for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    return texts + [texts[0], texts[1] + "tail", None, "", "x" * 199, "x" * 200, "ab" * 150]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("crowd", [S.CROWD, 3])
def test_random_texts(spark, make_docs, seed, crowd):
    check(make_docs([(i // 2, t) for i, t in enumerate(_texts(seed))], clash=True).repartition(4), crowd=crowd)


def test_window_edges(spark, make_docs):
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    a, b, c = fresh(199), fresh(200), fresh(201)
    texts = [a + fresh(50), fresh(9) + a, b, fresh(40) + b + fresh(3), c + "1", "2" + c, fresh(600), fresh(30) + b + b + b]
    texts += [fresh(70) + "z" * 199 + fresh(70), "z" * 200, "y" * 201]  # the last repeats inside itself
    check(make_docs(list(enumerate(texts))))


def test_hot_passage_is_halved(spark, make_docs):
    """One passage in most rows, amid text of their own: its edge groups are crowded down to single windows."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    own = lambda: "".join(rng.choice("ijklmn ") for _ in range(rng.randrange(3, 200)))
    docs = make_docs([(i, own() + passage + own()) for i in range(60)] + [(99, own() + passage[5:] + own())])
    check(docs, crowd=2)


def test_long_texts_in_parts(spark, make_docs):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2 * S.BLOCK + 5000))
    docs = make_docs([(1, long), (2, long[S.BLOCK - 700:S.BLOCK + 900]), (3, "q" + long[100:450])])
    rows = {r["doc_id"]: r for r in S.report(docs).collect()}
    assert (rows[1]["n_removed"], rows[2]["n_removed"], rows[3]["n_removed"]) == (1950, 1600, 350)


def test_anchors_cover_every_window_once():
    rng = np.random.RandomState(1)
    parts = [rng.randint(97, 100, n).astype(np.uint8) for n in (0, 150, 200, 3000, 0, 1200, 199)]
    ends = np.cumsum([len(p) for p in parts])
    begins = ends - [len(p) for p in parts]
    name, at, first, n = S.anchors(np.concatenate(parts), begins, ends)
    windows = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n)])
    assert windows.tolist() == [s for b, e in zip(begins, ends) for s in range(b, e - S.LENGTH + 1)]
    assert ((at >= first + n - 1) & (at - first < S.REACH)).all()


def _queue(spark, rows):
    batch = pa.Table.from_pylist(rows, pa.schema([("g", pa.int64()), *S._PIECE])).to_batches(max_chunksize=5)
    out = [b.to_pylist() for b in S._induce(scratch_path(spark))(iter(batch))]
    return sorted((r["a"], r["ph"], r["marks"]) for part in out for r in part)


def test_queue_on_disk_gives_the_same(spark, monkeypatch):
    """The induction alone, with all lanes on disk and blocks of few tuples."""
    rng = random.Random(2)
    shared = bytes(rng.choice(b"ab") for _ in range(420))
    rows = []
    for k in range(200):
        cut, g = rng.randrange(0, S.REACH), rng.randrange(3)
        left = bytes(rng.choice(b"ab") for _ in range(3)) + shared[160 - cut:160]
        high = min(len(left), S.REACH - 1)
        low = rng.randrange(0, high + 1)
        rows.append({"g": g, "a": g, "ph": k, "c": 1, "low": low, "high": high, "left": left[::-1][:high],
                     "right": (shared[160:160 + rng.randrange(100, 200)] + b"c" * 200)[:S.LENGTH - low]})
    rows.sort(key=lambda r: (r["g"], r["right"]))
    count = Counter((r["g"], d, r["left"][:d], r["right"][:S.LENGTH - d]) for r in rows for d in range(r["low"], r["high"] + 1))
    want = []
    for r in rows:
        marks = [int(r["low"] <= d <= r["high"] and count[r["g"], d, r["left"][:d], r["right"][:S.LENGTH - d]] > 1)
                 for d in range((S.REACH + 7) // 8 * 8)]
        if any(marks):
            want.append((r["a"], r["ph"], np.packbits(marks, bitorder="little").tobytes()))
    assert want and _queue(spark, rows) == sorted(want)
    monkeypatch.setattr(S, "HELD", 0)
    monkeypatch.setattr(S, "ROWS", 7)
    assert _queue(spark, rows) == sorted(want)


def test_range_min():
    rng = np.random.RandomState(0)
    v = rng.randint(0, 200, 500).astype(np.uint8)
    start = rng.randint(0, 500, 300)
    stop = np.minimum(start + rng.randint(0, 400, 300), 499)
    assert S.range_min(v, start, stop).tolist() == [int(v[a:b + 1].min()) for a, b in zip(start, stop)]


def test_odd_rows(spark, odd, make_docs):
    check(odd)
    check(make_docs([]))
    rows = S.dedup(make_docs([(1, "same text " * 30), (2, "same text " * 30), (3, "other")])).collect()
    assert {r["row"]["doc_id"]: [tuple(s) for s in r["spans"]] for r in rows} == {1: [(0, 300)], 2: [(0, 300)], 3: []}

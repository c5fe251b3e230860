"""Phrase mining against a plain count of everything, its SQL twin, and odd rows."""
from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import phrases as P, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f.update((lang, *ws[i:i + m]) for i in range(len(ws) - m + 1))
    cand = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    gone = set()
    for p, c in cand.items():
        words = p[1:]
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = (p[0], *words[i:i + m])
                if 100 * c >= share * f[inner]:
                    gone.add(inner)
    found = {}
    for p, a in cand.items():
        if p in gone:
            continue
        lang, *words = p
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, w.decode(), -a, left, right, n[lang], -s)
                  for lang, rows in found.items() for i, (s, a, w, left, right) in enumerate(sorted(rows)[:top]))


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark, documents):
    rows = [tuple(r) for r in documents.select("lang", "text").collect()]
    assert found(P.collocations(documents)) == plain(rows)


def test_sql_twin(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert found(queries.op12_phrases(spark, SF)) == sorted(con.sql(queries.oracle_sql()["op12_phrases"]).fetchall())


def _docs(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumn("key", F.lit("clash")).withColumn(
        "doc_id", F.lit(None).cast("bigint"))


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_in_small_tiles(spark, monkeypatch, seed):
    """Few ranks, small tiles, shared slots and short buffers, so that all ways of counting are taken."""
    for name, value in {"RANKED": 4, "SIDE": 2, "CROWDED": 8, "DENSE": 2, "HELD": 50, "_SLOTS": 16, "BLOCK": 300}.items():
        monkeypatch.setattr(P, name, value)
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "the", "The", "naïve", "É", "é", "文字", "😀", "longer-than-eight", "longer-than-eight2",
                  "x" * 40, "\x00", "d e"] + [f"w{i}" for i in range(20)]
    rows = [(rng.choice(["en", "de", None, "und"]),
             "".join(rng.choice(vocabulary[:rng.randrange(3, 35)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b"])
                     for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, "..."), ("de", " ")] + [("en", "same row twice over")] * 12
    from stallkeeper.llm.common import tune
    blocks = list(P._blocks(iter([__import__("pyarrow").record_batch(
        {"lang": [r[0] or "und" for r in rows], "text": [r[1] or "" for r in rows]})])))
    tiles = P.Tiles(np.arange(16, dtype=np.int64))
    assert len(blocks) > 4 and (tiles.rank(np.array([3, 99])) == [3, -1]).all()
    # Tasks run in other processes, where these settings do not hold: count here, in one process.
    counts = Counter()
    from stallkeeper.llm.lines import SIEVE

    class Shared:
        def __init__(self, value):
            self.value = value

    batch = __import__("pyarrow").record_batch({"lang": [r[0] or "und" for r in rows], "text": [r[1] or "" for r in rows]})
    keys = Counter()
    for lang, texts in blocks:
        keys.update(P.words(lang, texts)[0].tolist())
    ranked = np.array([k for k, _ in keys.most_common(16)], np.int64)
    for out in P._count_pairs(1, Shared(np.full(SIEVE // 64, -1)), Shared(ranked))(iter([batch])):
        for x, y, c in zip(*(column.to_pylist() for column in out.columns)):
            counts[x, y] += c
    plainly = Counter()
    for lang, texts in blocks:
        for text in texts:
            for piece in re.split("[.,;:!?\x0a-\x0d]", text.decode().translate(LOWER)):
                ws = [int(P.words(lang, [w.encode()])[0][0]) for w in re.findall("[^ \t]+", piece)]
                plainly.update(zip(ws, ws[1:]))
    assert counts == plainly
    tune(spark)
    assert found(P.collocations(_docs(spark, rows).repartition(3))) == plain(rows)


def test_longer_phrases_thresholds_and_limit(spark):
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choice("abcdef") for _ in range(40))) for _ in range(80)] + [("en", "one two three four five")] * 7
    for kind in ({"longest": 4, "least": 5}, {"longest": 5, "least": 3, "share": 80}, {"longest": 2}, {"top": 7}):
        assert found(P.collocations(_docs(spark, rows), **kind)) == plain(rows, **kind)


def test_counts_beyond_64_bits(spark):
    big = 3_000_000_000_000
    frame = spark.createDataFrame([(big, [big + 1, big], [big + 2, big])], "f bigint, heads array<bigint>, tails array<bigint>")
    cut = frame.select(P.weakest_cut(2).alias("c")).first()["c"]
    assert cut["score"] == 1_000_000 * big * big // ((big + 1) * (big + 2))


def test_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("lang", "text").collect()]
    assert found(P.collocations(odd)) == plain(rows)
    none = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(none).collect() == []

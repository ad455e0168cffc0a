import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortry.llm.language import held_out
from cohortry.llm.language_model import DISCOUNTED, good_turing, score_texts


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


class Brute:
    """The model by its definition, one dictionary at a time."""

    def __init__(self, texts):
        self.c, self.cc = Counter(), defaultdict(Counter)
        for t in texts:
            before = "<s>"
            for w in tokens(t):
                self.c[w] += 1
                self.cc[before, None][w] += 1
                before = ("w", w)
        self.n = sum(self.c.values())
        self.d1 = good_turing([0] + [sum(v == r for v in self.c.values()) for r in range(1, DISCOUNTED + 2)])
        pairs = [v for x in self.cc.values() for v in x.values()]
        self.d2 = good_turing([0] + [pairs.count(r) for r in range(1, DISCOUNTED + 2)])
        n1, n2 = (sum(v == r for v in self.c.values()) for r in (1, 2))
        self.kinds = max(1.0, n1**2 / (2 * max(n2, 1)))
        kept = sum(self.f(self.d1, v) * v for v in self.c.values())
        self.scale1 = 1 / max(self.n, 1) if kept < self.n or not self.n else 1 / (self.n + 1)
        self.rest = 1 - sum(self.f(self.d1, v) * v for v in self.c.values()) * self.scale1

    @staticmethod
    def f(d, r):
        return d[min(r, DISCOUNTED + 1)]

    def p1(self, w):
        return self.f(self.d1, self.c[w]) * self.c[w] * self.scale1 if self.c[w] else self.rest / self.kinds

    def p(self, before, w):
        seen = self.cc.get((before, None))
        if not seen:
            return self.p1(w)
        t = sum(seen.values())
        kept = sum(self.f(self.d2, v) * v for v in seen.values())
        scale = 1 / t if kept < t else 1 / (t + 1)
        if seen[w]:
            return self.f(self.d2, seen[w]) * seen[w] * scale
        return (1 - kept * scale) / (1 - sum(self.p1(x) for x in seen if seen[x])) * self.p1(w)

    def score(self, text):
        total, before = 0.0, "<s>"
        for w in tokens(text):
            total += math.log10(self.p(before, w))
            before = ("w", w)
        return total


def test_equals_brute_force_and_is_normalised(spark):
    rows = [r[:2] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t[:1500]) for i, t in rows] + [(1001, None), (1002, ""), (1003, "The the THE"), (1003, "The the THE"), (None, "of the unheardof")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = score_texts(docs, held_out(F.col("doc_id"), 7), block_bytes=20_000).collect()
    assert len(got) == len(rows)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    brute = Brute([t for i, t in rows if not out(i)])
    for r in got:
        t = next(t for i, t in rows if i == r["doc_id"])
        ws = tokens(t)
        assert r["held_out"] == out(r["doc_id"]) and r["n_tokens"] == len(ws) and r["train_tokens"] == brute.n
        assert r["n_known"] == sum(brute.c[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((brute.c[w] + 1) / (brute.n + len(brute.c) + 1)) for w in ws), rel=1e-9)
        assert r["score"] == pytest.approx(brute.score(t), rel=1e-9)
    for before in ["<s>", ("w", "the"), ("w", "of"), ("w", "unheardof")]:
        assert sum(brute.p(before, w) for w in brute.c) + brute.kinds * brute.p(before, "not a word seen") == pytest.approx(1, abs=1e-9)
    better = sum(r["score"] for r in got if r["held_out"]) - sum(r["base_score"] for r in got if r["held_out"])
    assert better > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(docs, F.lit(False)).count() == 0

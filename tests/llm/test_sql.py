"""Queries that SQL can express against DuckDB, and all others against brute force on whole small tables."""

import base64
import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cohortry.llm import bpe, language, near_dedup, queries
from cohortry.llm.quality import quality
from differential import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def parse(text: str, reference: str) -> int:
    """Phrases of the greedy parse by search."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in reference:
            j += 1
        i, n = j, n + 1
    return n


def test_phrases_equal_search():
    table = language.symbol_table(["the cat sat on the mat", "der hund und die katze"])
    refs = ["the cat sat on the mat and the rat", "der hund und die katze"]
    codes = [language.symbols_of(r, table) for r in refs]
    parsers = [language.Parser(c, int(table.max()) + 1) for c in codes]
    texts = ["the hat", "die katze und", "qqq", "thecat on a mat " * 3]
    found = [language.symbols_of(t, table) for t in texts]
    as_text = lambda c: "".join(chr(97 + int(x)) for x in c)
    for copies in (1, 30):  # a few texts are parsed one by one, many step together
        got = language.count_phrases(found * copies, parsers)
        for i, t in enumerate(found * copies):
            assert list(got[i]) == [parse(as_text(t), as_text(c)) for c in codes]


def best_by_search(text: str, sample: dict, table) -> tuple:
    """(language, score) of a text by the definition."""
    import math

    as_text = lambda s: "".join(chr(0x4E00 + int(x)) for x in language.symbols_of(s, table))
    refs = {k: as_text(v) for k, v in sample.items()}
    if not any(c.isalpha() for c in text or "") or not refs:
        return "und", 0.0
    cost = {k: (parse(as_text(text), r) + 1) * math.log2(len(r) + 1) for k, r in refs.items()}
    best = min(sorted(cost), key=cost.get)
    return best, 1 / cost[best] / sum(1 / c for c in cost.values())


def test_whole_query_equals_search(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    sample = language.training_sample(d.where(~language.held_out(F.col("doc_id"), 4)), "text", "lang")
    table = language.symbol_table(list(sample.values()))
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        if len(t or "") < 6000:
            want = best_by_search(t, sample, table)
            assert got[i]["lang_pred"] == want[0] and got[i]["score"] == pytest.approx(want[1], rel=1e-12)


def test_alphabets_of_thousands_of_letters_in_blocks_of_languages(spark):
    import random

    rng = random.Random(5)
    words = {"a": [chr(0x4E00 + rng.randrange(3000)) * 2 for _ in range(900)], "b": [chr(0xAC00 + rng.randrange(4000)) + chr(0x4E00 + rng.randrange(3000)) for _ in range(900)], "c": ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]}
    rows = [(f"{k}{i}", k, " ".join(rng.choices(words[k], k=60))) for k in words for i in range(40)] + [("x", None, None)]
    d = spark.createDataFrame(rows, "doc_id string, lang string, text string")
    model = language.train(d)
    for block_bytes in (1 << 30, 1):
        got = {r["doc_id"]: r for r in language.identify(d, model, block_bytes=block_bytes).collect()}
        assert len(got) == len(rows) and all(r["lang_pred"] == (r["lang"] or "und") for r in got.values())
    sample = language.training_sample(d, "text", "lang", sample_chars=50)
    assert all(0 < len(t) <= 50 for t in sample.values())  # no whole text fits: a stretch of one


def test_language_accuracy(spark):
    rows = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows if r["held_out"])
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_tokens_equal_tiktoken(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.parse_ranks(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    assert len(ranks) == 50256 and base64
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op6_byte_bpe(spark, SF).collect():
        ids = own.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def brute_classes(docs: dict) -> dict:
    words = {i: near_dedup.words_of(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if docs[a] == docs[b] or near_dedup.similarity(words[a], words[b]) >= near_dedup.SIMILARITY:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in docs}


def test_near_classes_equal_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in queries.op7_near_dedup(spark, SF).collect()}
    want = brute_classes(docs)
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_banded_matches_equal_dynamic_program():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        band = rng.randint(0, 6)
        low = 0
        while low < min(len(a), len(b)) and a[low] == b[low]:
            low += 1
        # Equal ends are matched first, so the band is that of the middle.
        high = 0
        while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
            high += 1
        x, y = a[low : len(a) - high], b[low : len(b) - high]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (x[i - 1] == y[j - 1] and abs(i - j) <= band))
        assert near_dedup.banded_matches(a, b, band) == low + high + best[-1][-1]


def placed(rows: list, n: int, heavy_share: float) -> dict:
    """Shard by id, from (id, size, key, tie): light groups along one line of keys, heavy ones row by row."""
    total, groups = sum(r[1] for r in rows), defaultdict(int)
    for _, size, key, _ in rows:
        groups[key] += size
    heavy = {k: v for k, v in groups.items() if v > max(1.0, heavy_share * total / n)}
    room, shares, out = [total / n] * n, {}, {}
    for key in sorted(heavy, key=lambda k: (-heavy[k], k)):
        left, shares[key] = float(heavy[key]), []
        while left > 1e-9:
            s = max(range(n), key=lambda i: (room[i], -i))
            take = left if left <= room[s] or room[s] <= 0 else room[s]
            shares[key].append((s, take))
            room[s] -= take
            left -= take
    light = sum(r[1] for r in rows if r[2] not in heavy)
    room = [max(0.0, x) for x in room]
    ends = [light * sum(room[: i + 1]) / (sum(room) or 1.0) for i in range(n)]
    before, at = 0, {}
    for i, size, key, _ in sorted((r for r in rows if r[2] not in heavy), key=lambda r: (r[2], r[3])):
        at.setdefault(key, before)
        out[i] = min(sum(e <= at[key] + 1e-6 for e in ends), n - 1)
        before += size
    return out | {r[0]: {s for s, _ in shares[r[2]]} for r in rows if r[2] in heavy}


@pytest.mark.parametrize("skewed", [False, True])
def test_shards_keep_their_law(spark, skewed, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if skewed:  # a third of the rows are copies of one text
        docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("the same words again and again " * 20)).otherwise(F.col("text")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op9_sharding(spark, str(tmp_path)).collect()
    sizes = {r[0]: (r[1], r[2]) for r in docs.select("doc_id", F.octet_length("text") + 1, F.crc32(F.col("text").cast("binary"))).collect()}
    assert len(rows) == len(sizes) and all((r["size"], r["text_crc32"]) == sizes[r["doc_id"]] for r in rows)
    total, by = sum(r["size"] for r in rows), defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(8)) and all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    largest = max(r["size"] for r in rows)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 8) <= max(0.01 * total / 8, largest)
    homes = defaultdict(set)
    for r in rows:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert skewed or all(len(h) == 1 for h in homes.values())
    keyed = docs.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    keyed = keyed.select("doc_id", F.octet_length("text") + 1, F.xxhash64("text"), F.xxhash64("doc_id", "crc"))
    want = placed([tuple(r) for r in keyed.collect()], 8, 0.02)
    assert all(r["shard"] in want[r["doc_id"]] if isinstance(want[r["doc_id"]], set) else r["shard"] == want[r["doc_id"]] for r in rows)


def test_quality_equals_brute_force(spark):
    """Rates, shrinkage and posteriors of whole documents from the evidence of the trained classifiers."""
    import math

    import numpy as np

    from cohortry.llm import exchange, quality as Q

    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(d, labels, ["quality", "toxic"], "text", "doc_id")
    hashes, rows = exchange.WordHashes(), d.collect()
    sigmoid, logit = lambda x: 1 / (1 + math.exp(-x)), lambda p: math.log(p / (1 - p))
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in rows}

    def strength(groups):
        """groups: (n, s, parent)"""
        groups = [g for g in groups if g[0] >= 2]
        parents = {g[2] for g in groups}
        free = len(groups) - len(parents)
        if not free:
            return 100.0
        mean = sum(g[1] for g in groups) / sum(g[0] for g in groups)
        spread = room = 0.0
        for p in parents:
            own = [g for g in groups if g[2] == p]
            n, s = sum(g[0] for g in own), sum(g[1] for g in own)
            spread += sum(g[0] * (g[1] / g[0] - s / n) ** 2 for g in own)
            room += n - sum(g[0] ** 2 for g in own) / n
        noise = max(mean * (1 - mean), 1e-9)
        between = max(spread - free * noise, 0.0) / max(room, 1.0)
        return min(max(noise / between - 1 if between > 0 else 1e4, 1.0), 1e4)

    for name, m in model.items():
        llr = {r["doc_id"]: m["bias"] + float(m["weights"][Q.features(r["text"] or "", hashes)].sum(dtype=np.float64)) for r in rows}
        own = {i: sigmoid(x + logit(m["prior"])) for i, x in llr.items()}
        host, path = defaultdict(list), defaultdict(list)
        for r in rows:
            host[r["source"] or ""].append(own[r["doc_id"]])
            path[r["source"] or "", "/".join(x for x in (r["source"], r["lang"]) if x is not None)].append(own[r["doc_id"]])
        rate = (sum(own.values()) + m["prior"]) / (len(rows) + 1)
        kh = strength([(len(v), sum(v), 0) for v in host.values()])
        kp = strength([(len(v), sum(v), k[0]) for k, v in path.items()])
        for r in rows:
            h, p = host[r["source"] or ""], path[r["source"] or "", "/".join(x for x in (r["source"], r["lang"]) if x is not None)]
            of_host = (sum(h) + kh * rate) / (len(h) + kh)
            prior = (sum(p) - own[r["doc_id"]] + kp * of_host) / (len(p) - 1 + kp)
            want = sigmoid(llr[r["doc_id"]] + logit(min(max(prior, 1e-6), 1 - 1e-6)))
            assert got[r["doc_id"]][f"p_{name}"] == pytest.approx(want, rel=1e-6, abs=1e-12)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = quality(spark.read.parquet(f"{sf}/documents.parquet"), half, F.col("source"), F.col("lang"), ["quality"]).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = got.select("quality", "p_quality").collect()
    good = [r["p_quality"] for r in rows if r["quality"] == 1]
    bad = [r["p_quality"] for r in rows if r["quality"] == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.8

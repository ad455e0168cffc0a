"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from cohortry.llm import bpe, language, queries
from cohortry.llm.contamination import decontaminate, find_contamination
from cohortry.llm.exact_dedup import drop_copies, exact_groups
from cohortry.llm.language_model import score_texts
from cohortry.llm.line_dedup import dedup_lines
from cohortry.llm.near_dedup import drop_near_copies, near_duplicates
from cohortry.llm.quality import quality
from cohortry.llm.sharding import shards
from cohortry.llm.substring_dedup import repeated_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, shard int, slot int, ids string, keys int, h int, n int, label string, score string, digest int, class_id int, held int, w int, items int, decoded int"
LONG = " ".join(f"w{i % 9973}x{i % 7}" for i in range(60_000))
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def row(i, t, lang="en"):
    return (i, t, lang, None if i == 3 else "s", None, *[None] * 16)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        row(None, None), row(1, None), row(2, ""), row(3, " \t\n "), row(4, LONG), row(5, LONG), row(6, LONG + " tail"), row(7, "same text here"), row(7, "same text here"), row(7, "another text"),
        row(8, "Same text here", None), row(9, ITEM.upper() + "!"), row(10, "zwölf Äpfel und ÜBER 123 漢字 😀"), row(11, "12345 !!!", None), row(12, "a"), row(None, "no id at all"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, "same text"), (3, None), (4, " . "), (None, "lonely words")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1, 0), (9, 0, 1), (12, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def vocabulary():
    import public_tokenizers as P

    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN


def operators(benchmark, labels):
    ranks, pattern = vocabulary()
    return {
        "contamination": lambda d: find_contamination(d, benchmark),
        "language": lambda d: language.identify(d, language.train(d)),
        "model": lambda d: score_texts(d, F.col("doc_id") == 4),
        "quality": lambda d: quality(d, labels, F.col("source"), F.col("lang"), ["quality", "toxic"]),
        "lines": lambda d: dedup_lines(d, min_chars=4, min_docs=2),
        "bpe": lambda d: bpe.decode(bpe.encode(d, ranks, pattern), ranks),
        "near": near_duplicates,
        "exact": exact_groups,
        "shards": shards,
        "passages": lambda d: repeated_passages(d, 3),
    }


@pytest.mark.parametrize("name", ["contamination", "language", "model", "quality", "lines", "bpe", "near", "exact", "shards", "passages"])
def test_one_row_each_and_none_for_an_empty_table(name, docs, benchmark, labels):
    run = operators(benchmark, labels)[name]
    ids = sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert sorted(str(r["doc_id"]) for r in run(docs).select("doc_id").collect()) == ids
    assert run(docs.where("doc_id = -1")).count() == 0


def test_contamination(docs, benchmark):
    got = {(r["doc_id"], r["n_words"]): r for r in find_contamination(docs, benchmark).collect()}
    assert got[9, 14]["n_hit"] == 14 and got[9, 14]["items"] == ["1"]
    assert got[7, 3]["n_hit"] == 2 and got[8, 3]["items"] == ["2"] and got[1, 0]["n_hit"] == 0
    small = {(r["doc_id"], r["n_words"]): r["n_hit"] for r in find_contamination(docs, benchmark, block_bytes=2000).collect()}
    assert small == {k: r["n_hit"] for k, r in got.items()}
    none = find_contamination(docs, benchmark.where("item_id = 99"))
    assert none.where("n_hit > 0").isEmpty() and none.count() == docs.count()
    span = {r["doc_id"]: r["text"] for r in decontaminate(docs, benchmark, mode="span").where("doc_id IN (8, 9, 12)").collect()}
    assert span == {8: "here", 9: "", 12: "a"}


def test_contamination_in_blocks_writes_no_texts(spark, benchmark, tmp_path):
    """Several blocks hash a text anew: what is written beside the windows doesn't grow with the texts."""
    from pathlib import Path

    size = lambda: sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if f.is_file())
    written = []
    for words in (1_000, 60_000):
        d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(words)) + " " + ITEM)], "doc_id long, text string")
        before = size()
        got = find_contamination(d, benchmark, block_bytes=2000).first()
        assert (got["n_words"], got["n_hit"], got["items"]) == (words + 14, 14, ["1"])
        written.append(size() - before)
    assert written[1] < 2 * written[0]


def test_language(docs):
    got = {(r["doc_id"], r["text"]): r for r in language.identify(docs, language.train(docs)).collect()}
    assert {got[k]["lang_pred"] for k in ((1, None), (2, ""), (11, "12345 !!!"))} == {"und"} and got[4, LONG]["lang_pred"] == "en"
    unlabelled = language.identify(docs, language.train(docs.where("lang IS NULL AND doc_id = 99")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"} and "lang" in unlabelled.columns


def test_exact_groups(docs):
    rows = exact_groups(docs).collect()
    empty = [r for r in rows if r["group_size"] == 3]
    assert {r["doc_id"] for r in empty} == {None, 1, 2} and {r["keep_id"] for r in empty} == {2}
    assert [r["kept"] for r in rows if r["doc_id"] == 5] == [True] and [r["keep_id"] for r in rows if r["doc_id"] == 4] == [5]
    # Equal digests of different texts don't make copies.
    weak = exact_groups(docs, digest=lambda t: F.length(t).cast("string"), hot_rows=1)
    key = lambda r: (str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"])
    assert sorted(map(key, weak.collect())) == sorted(map(key, rows))
    assert drop_copies(docs).columns == docs.columns and drop_copies(docs).where("doc_id = 4").isEmpty()


def test_lines(spark):
    rows = [(i, "x\nShared line\n  shared LINE\t\n\nown %d" % i) for i in range(3)] + [(9, "shared line!"), (None, "Shared line")]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=5, min_docs=3, batches=3).collect()}
    assert got[2]["text"] == rows[2][1] and got[2]["n_dropped"] == 0
    assert got[0]["text"] == "x\n\nown 0" and got[0]["n_dropped"] == 2 and got[0]["n_lines"] == 5
    assert got[None]["text"] == "" and got[None]["n_dropped"] == 1 and got[9]["n_dropped"] == 0


def test_round_trip(docs):
    ranks, pattern = vocabulary()
    for r in bpe.decode(bpe.encode(docs, ranks, pattern), ranks).collect():
        assert hashlib.md5(bytes(r["decoded"])).digest() == hashlib.md5((r["text"] or "").encode()).digest()


def test_one_python_worker_encodes_and_decodes(docs):
    ranks, pattern = vocabulary()
    apart = {repr(r["doc_id"]): (r["ids"], r["decoded"]) for r in bpe.decode(bpe.encode(docs, ranks, pattern), ranks).collect()}
    assert {repr(r["doc_id"]): (r["ids"], r["decoded"]) for r in bpe.encode_and_decode(docs, ranks, pattern).collect()} == apart
    stage = dict(corpus_pipeline.STAGES)["byte_bpe"](docs.sparkSession, docs, "")
    assert stage._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_ids_that_the_vocabulary_lacks(spark):
    ranks, _ = vocabulary()
    rows = [(1, [-1, 72, None, 99_999_999, 73, 50_256]), (2, None), (3, []), (4, [None])]
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), ranks).collect()}
    known = {i: t for t, i in bpe.parse_ranks(ranks).items()}
    assert got == {1: known[72] + known[73], 2: b"", 3: b"", 4: b""}


def test_lines_of_documents_with_names_as_ids(spark):
    rows = [(x, "A line shared by all\nown " + str(x)) for x in ("a", "b", "c", "d", None)] + [("b", "A line shared by all")]
    for batches in (1, 3):
        got = {(r["doc_id"], r["text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id string, text string"), min_chars=5, min_docs=3, batches=batches).collect()}
        assert got == {("a", "own a"), ("b", "own b"), ("b", ""), ("c", "own c"), ("d", rows[3][1]), (None, "own None")}


def test_settled_lines_leave_later_batches(spark):
    from cohortry.llm.line_dedup import LineRuns

    runs = LineRuns(min_docs=2, fanout=3)
    runs.add(spark.createDataFrame([(9, b"x"), (8, b"x"), (8, b"y")], "id long, h binary"))
    runs.add(spark.createDataFrame([(7, b"x"), (6, b"y"), (6, b"z")], "id long, h binary"))
    assert sorted(bytes(r["h"]) for r in runs.runs()[1].collect()) == [b"y", b"z"]
    runs.add(spark.createDataFrame([(5, b"z"), (4, b"x")], "id long, h binary"))
    assert {bytes(r["h"]): (r["n"], r["keeper"]) for r in LineRuns.merged(runs.runs()).collect()} == {b"x": (2, 9), b"y": (2, 8), b"z": (2, 6)}
    assert [len(level) for level in runs.levels] == [0, 1]


def test_internal_names_may_clash(spark, benchmark, labels):
    names = ["__gone", "__bad", "__spans", "__lang", "__score", "__key", "__tie", "__cell", "__id", "__text", "__digest", "__salt", "__n", "__costs_0"]
    rows = [(i, f"some words of text {i % 3}", "en", "s", *[str(i)] * len(names)) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for run in operators(benchmark, labels).values():
        assert run(d).count() == 6
    for stage in (drop_copies, drop_near_copies, lambda x: decontaminate(x, benchmark), lambda x: decontaminate(x, benchmark, mode="span")):
        out = stage(d)
        assert out.columns == d.columns and all(r["__gone"] == str(r["doc_id"]) for r in out.collect())
    said = corpus_pipeline.identify_language(spark, d, "")
    assert said.columns == d.columns and said.count() == 6


def test_near_copies(docs):
    got = [(r["doc_id"], r["class_id"]) for r in near_duplicates(docs).collect()]
    assert (6, 4) in got and (5, 4) in got and (8, 7) in got and (12, 12) in got and (2, None) in got
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (5, 6, 8)").isEmpty()


def test_passages(spark):
    a, b = " ".join(f"a{i}" for i in range(9)), " ".join(f"b{i}" for i in range(9))
    rows = [(1, f"{a} x {b}"), (2, f"{b}\ny  {b}"), (3, "a0 a1"), (4, None), (5, f"A0 {a[3:]}")]
    got = {r["doc_id"]: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got[1]["text"] == "a0 x" and got[2]["text"] == "y" and got[3]["text"] == "a0 a1" and got[4]["n_words"] == 0 and got[5]["text"] == "A0"
    assert [tuple(s) for s in got[2]["spans"]] == [(0, 9), (10, 19)]


@pytest.mark.parametrize("how", [{"bits": 1}, {"hot": 3}, {"hot": 1, "bits": 2, "block_bytes": 20_000}])
def test_passages_do_not_depend_on_hashes_or_blocks(spark, how):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(1000, "a b " * 90), (1001, "a b " * 90), (1002, "b a " * 40), (1003, "z " * 200)]
    d = d.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {r["doc_id"]: (r["n_removed"], r["spans"]) for r in repeated_passages(d).collect()}
    assert want[1000] == (180, [(0, 180)]) and want[1002] == (80, [(0, 80)]) and want[1003] == (200, [(0, 200)])
    assert {r["doc_id"]: (r["n_removed"], r["spans"]) for r in repeated_passages(d, **how).collect()} == want


def test_shards_of_one_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i} " + "z" * (i % 50)) for i in range(600)]
    got = shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sums = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in got) + 0.04 * sum(sums) / 8
    big = spark.createDataFrame([(i, "y" * 500) for i in range(90)] + [(100 + i, f"t{i}") for i in range(300)], "doc_id long, text string")
    sums = {r["shard"]: r["s"] for r in shards(big).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 1100  # the group is larger than a shard and is subdivided


def test_cells_of_nearly_empty_texts(spark):
    """Nine tenths have no text: they weigh little, but no task sorts them all."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("z"), 40))).alias("text"))
    out = shards(rows, keep=["doc_id"], cell_rows=2000)
    got = out.collect()
    sums = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 0.01 * sum(sums) and len({r["doc_id"] for r in got}) == 60_000
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sharded = next(n for n in _leaves(out) if "__cell" in n.columns)
    assert sharded.groupBy("__cell").count().agg(F.max("count")).first()[0] <= 4000


def _leaves(df):
    """The tables that df reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        yield df.sparkSession.read.parquet(path)


def test_stages(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.where("doc_id = -1")):
            out = stage(spark, d, str(tmp_path))
            assert out.count() <= d.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == d.columns


def test_pipeline_equals_brute_force(spark):
    import test_sql

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    last = {t: i for i, t in sorted(kept.items())}
    kept = {i: t for t, i in last.items()}
    kept = {i: kept[i] for i, c in test_sql.brute_classes(kept).items() if i == c}
    import re

    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    clean = set()
    for i, t in kept.items():
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == clean
    assert all(r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for r in got)


def test_the_query_of_tokens_uses_one_python_worker(spark):
    plan = queries.op6_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_trees_of_one_and_more_levels_merge_the_leftmost_lowest_pair():
    ranks = {bytes([97 + i]): i for i in range(3)} | {t: i for i, t in enumerate((b"aa", b"ab", b"bc", b"aab", b"abc", b"aaaa", b"bcaa"), 3)}
    rng = random.Random(5)
    for n in [*range(1, 70), bpe.FAN**2 - 1, bpe.FAN**2, bpe.FAN**2 + 1]:
        piece = bytes(rng.choice(b"abc") for _ in range(n))
        parts = [piece[i : i + 1] for i in range(n)] if piece not in ranks else [piece]
        while pairs := [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]:
            at = min(pairs)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert bpe.merge_piece(piece, ranks) == tuple(ranks[x] for x in parts)


def test_remembered_pieces_are_few_and_the_frequent_ones_stay(monkeypatch):
    ranks, merged, merge = bpe.parse_ranks(vocabulary()[0]), [], bpe.merge_piece
    monkeypatch.setattr(bpe, "merge_piece", lambda piece, ranks: merged.append(piece) or merge(piece, ranks))
    pieces = bpe.Pieces(ranks, 4)
    for i in range(50):
        for piece in (" frequent", f"w{i}xyzäö"):
            assert np.frombuffer(pieces[piece], np.int32).tolist() == list(merge(piece.encode(), ranks))
            assert len(pieces) + len(pieces.aside) <= 8
    assert merged.count(b" frequent") == 1 and len(merged) == 51


def test_encoding_and_decoding_in_parts_of_few_rows():
    import pyarrow as pa

    raw, pattern = vocabulary()
    ranks, shared, texts = bpe.parse_ranks(raw), SimpleNamespace(value=raw), [None, "", "zwölf Äpfel 漢字 😀", "same text  here"] * 100
    batch = pa.RecordBatch.from_pydict({"text": pa.array([*texts, *[None] * 200])})
    got = list(bpe._decoder(shared, 1, ["text", "ids", "decoded"])(bpe._encoder(shared, pattern, 0, ["text", "ids"])([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in got) <= 128 and sum(b.num_rows for b in got) == 600
    for t, ids, decoded in zip([*texts, *[None] * 200], *([x for b in got for x in b.column(c).to_pylist()] for c in (1, 2)), strict=True):
        assert decoded == (t or "").encode() and ids == [i for p in regex.findall(pattern, t or "") for i in bpe.merge_piece(p.encode(), ranks)]

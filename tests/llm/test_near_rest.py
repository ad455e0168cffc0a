import random
import time
from pathlib import Path

from cohortry.llm.near_dedup import near_duplicates, similarity, words_of


def _classes(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}


def _brute(texts):
    words, label = {i: words_of(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and label[a] != label[b] and similarity(words[a], words[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def test_copies_of_a_passage_that_longer_documents_quote(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(20000)}"
    passage = [word() for _ in range(200)]
    texts = {i: " ".join([*passage, *(word() for _ in range(rng.randrange(60, 220)))]) for i in range(60)}
    for i in range(60, 64):
        copy = list(passage)
        for at in rng.sample(range(200), 6):
            copy[at] = word()
        texts[i] = " ".join(copy)
    # A second class, as long as its bucket's leaders but unlike them.
    for i in range(100, 110):
        texts[i] = " ".join([*passage, *(f"x{k if k % 40 else rng.randrange(9)}" for k in range(190))])
    got, said = _classes(spark, texts), _brute(texts)
    assert len({said[i] for i in range(60, 64)}) == 1 and len({said[i] for i in range(100, 110)}) == 1
    assert got == said


def test_bucket_of_several_cells(spark, monkeypatch):
    from cohortry.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(80)]
    texts = {i: " ".join([*passage, *(f"w{rng.randrange(5000)}" for _ in range(40))]) for i in range(60)}
    for i in range(60, 100):
        texts[i] = " ".join([*passage, *(f"y{(i % 8) * 1000 + k if k % 9 else rng.randrange(99)}" for k in range(40))])
    assert _classes(spark, texts) == _brute(texts)


def test_long_texts_and_ids_of_any_type(spark):
    from cohortry.llm.near_dedup import banded_matches

    rng = random.Random(4)
    a = [f"w{rng.randrange(40)}" if i % 3 else f"u{i}" for i in range(6000)]
    b = [w for i, w in enumerate(a) if i % 50]
    best = [0] * (len(b) + 1)
    for i, x in enumerate(a):  # the plain table, row by row
        row = [0]
        for j, y in enumerate(b):
            row.append(max(row[j], best[j + 1], best[j] + (x == y and abs(i - j) <= 1300)))
        best = row
    assert banded_matches(a, b, 1300) == best[-1]
    rows = [("b", " ".join(a)), ("a", " ".join(b)), ("c", "other words"), (None, "other  words"), ("d", None), ("c", "one more")]
    got = {(r["doc_id"], r["class_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("a", "a", True), ("b", "a", False), (None, None, True), ("c", None, False), ("d", "d", True)}


def test_only_what_the_result_needs_stays_on_disk(spark):
    texts = {i: " ".join(f"w{(i // 3, j) if j else i}" for j in range(80)) for i in range(90)}
    docs, setting = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    near_duplicates(docs)  # the folder is there now
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in local for f in Path(d).rglob("shuffle_*.data")}
    tables, before, was = set(shared.rglob("*.parquet")), shuffled(), spark.conf.get(setting)
    said = near_duplicates(docs)
    assert set(shared.rglob("*.parquet")) == tables and spark.conf.get(setting) == was
    end = time.time() + 20
    while len(left := shuffled() - before) > 16 and time.time() < end:  # files go in the background
        time.sleep(0.2)
    assert len(left) <= 16  # of the last table, whose frame is returned
    assert [said.count() for _ in range(2)] == [90, 90] and said.where("kept").count() == 30

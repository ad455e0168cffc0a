"""The registered queries of the training-data operators: op<N>_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, language, mixture, vector_codes
from .common import documents, written
from .contamination import find_contamination, is_contaminated
from .exact_dedup import exact_groups
from .language_model import score_texts
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .quality import quality
from .sharding import shards
from .substring_dedup import repeated_passages


def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.where(~language.held_out(F.col("doc_id"), 4)))
    said = language.identify(docs.select("doc_id", "text"), model)
    return said.select("doc_id", language.held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), language.held_out(F.col("doc_id"), 7))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    path = F.concat_ws("/", "source", "lang")
    judged = quality(documents(spark, sf_dir), labels, F.col("source"), path, ["quality", "toxic"])
    return judged.withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = documents(spark, sf_dir).select("doc_id", "text", crc.alias("text_crc32"))
    dealt = shards(rows, keep=["doc_id", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeated_passages(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vector_codes.train(rows)
    coded = written(vector_codes.encode(rows, books).select("vec_id", "label", "code", "error"))
    return vector_codes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    fixed = conversations.repair(conversations.damaged(rows))
    said = rows.select("conv_id").distinct().unionByName(fixed.reports, True).unionByName(conversations.digests(fixed.turns), True)
    numbers, empty = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), F.sha2(F.lit("").cast("binary"), 256)
    return said.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"),
    )


def op13_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(mixture.mix(documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (
    op1_contamination, op2_language_id, op3_language_model, op4_quality, op5_line_dedup, op6_byte_bpe, op7_near_dedup, op8_exact_dedup, op9_sharding, op10_substring_dedup,
    op11_vector_codes, op12_conversation_repair, op13_source_mixture,
)}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_contamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len, w[i:i + len - 1] AS win FROM (
    SELECT item_id, w, least(13, len(w)) AS len, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM bw),
dw AS (SELECT doc_id, lens.len, i, w[i:i + lens.len - 1] AS win FROM d, lens, unnest(range(1, len(w) - lens.len + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dw.len AS len, item_id FROM dw JOIN bw ON dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM (SELECT DISTINCT doc_id, i, len FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, i, line, r.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op10_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
r AS (SELECT doc_id, i FROM v JOIN (SELECT h FROM v GROUP BY h HAVING count(*) > 1) USING (h)),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_vector_codes": """
WITH k AS (SELECT vec_id, label, embedding AS e, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, p, list_transform(e[p * w + 1 : (p + 1) * w], lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM k, range(16) AS t(p)),
b0 AS (SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
a0 AS (SELECT vec_id, p, any_value(v) AS v, min(struct_pack(d := d, j := j)) AS near FROM (SELECT vec_id, p, p.v, j, list_sum(list_transform(list_zip(p.v, b0.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b0 USING (p)) GROUP BY 1, 2),
m0 AS (SELECT p, j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT p, near.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM a0, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b1 AS (SELECT p, j, coalesce(m0.v, b0.v) AS v FROM b0 LEFT JOIN m0 USING (p, j)),
a1 AS (SELECT vec_id, p, any_value(v) AS v, min(struct_pack(d := d, j := j)) AS near FROM (SELECT vec_id, p, p.v, j, list_sum(list_transform(list_zip(p.v, b1.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b1 USING (p)) GROUP BY 1, 2),
m1 AS (SELECT p, j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT p, near.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM a1, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b2 AS (SELECT p, j, coalesce(m1.v, b1.v) AS v FROM b1 LEFT JOIN m1 USING (p, j)),
a2 AS (SELECT vec_id, p, min(struct_pack(d := d, j := j)) AS near FROM (SELECT vec_id, p, j, list_sum(list_transform(list_zip(p.v, b2.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b2 USING (p)) GROUP BY 1, 2),
c AS (SELECT vec_id, string_agg(printf('%02x', near.j), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a2 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h""",
    "op12_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
r AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM r, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
o AS (SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS two FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate,
  count_if(NOT blank AND NOT dup AND cut) AS truncated, count_if(two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY 1),
ins(p, q, price, word, said) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']),
  (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (3, 3, 10, 'II', ['user:', 'assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:'])),
edits(q, edit, t, ini, role, price) AS (VALUES (0, 'D', 0, '', '', 2), (1, 'D', 1, '', '', 2), (2, 'D', 2, '', '', 2), (3, 'D', 3, '', '', 2), (0, 'K', 1, 's', '', 0), (0, 'K', 2, 'u', '', 0), (1, 'K', 2, 'u', '', 0), (3, 'K', 2, 'u', '', 0),
  (2, 'K', 3, 'a', '', 0), (0, 'R', 2, '', 'user', 1), (1, 'R', 2, '', 'user', 1), (3, 'R', 2, '', 'user', 1), (2, 'R', 3, '', 'assistant', 1)),
w(conv_id, i, state, cost, audit, said) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '', []::VARCHAR[] FROM s
  UNION ALL
  SELECT conv_id, i, t, best.cost, best.audit, best.said FROM (
    SELECT w.conv_id, f.i, e.t, min(struct_pack(
      cost := w.cost + ins.price + e.price + CASE WHEN e.edit <> 'D' AND f.cut THEN 5 ELSE 0 END, audit := w.audit || ins.word || e.edit,
      said := list_concat(w.said, ins.said, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.role || ':' || f.text] END))) AS best
    FROM w JOIN f ON f.conv_id = w.conv_id AND f.i = w.i + 1 JOIN ins ON ins.p = w.state JOIN edits e ON e.q = ins.q
    WHERE e.edit = 'D' OR (NOT f.blank AND NOT f.dup AND (e.edit = 'R' OR e.ini = f.ini))
    GROUP BY 1, 2, 3)),
z AS (SELECT w.conv_id, min(struct_pack(cost := cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, audit := audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
  said := list_concat(said, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END))) AS best FROM w JOIN s ON s.conv_id = w.conv_id AND w.i = s.n GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN z USING (conv_id)""",
    "op13_source_mixture": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM (SELECT source, sum(size) AS s FROM d GROUP BY 1)),
held AS (SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS rate, row_number() OVER (ORDER BY 3 * s / w, source) AS n
  FROM s WINDOW before AS (ORDER BY 3 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT arg_min(rate, n) AS rate FROM held WHERE rate * w <= 3 * s),
t AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), rate * w) AS target FROM s, r),
l AS (SELECT d.*, s, target, CAST(floor(target + 0.5) AS BIGINT) AS words, sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
  CAST(CASE WHEN s = 0 THEN 0 ELSE words // s * size + greatest(0, least(size, words % s - begin)) END AS BIGINT) AS taken FROM l""",
}

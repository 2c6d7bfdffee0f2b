"""One query per operator, over its whole table, and its SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, licenses, lines, lm, mixing, ngram_join, quality, resampling, spelling, substring, tokens
from .common import shared_dir

WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len({WORDS_SQL}), 0) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
        - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= cap / w) * w, cap)) AS target FROM l),
q AS (SELECT doc_id, d.source, size, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS b FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(greatest(0, least(size, floor(target) - b)) + greatest(0, least(size, floor(target) - b - source_size)) AS BIGINT) AS taken
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source
"""


def op8_lines(spark, sf_dir):
    x = lines.line_dedup(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, i, l[i] || chr(10) || l[i+1] || chr(10) || l[i+2] AS k FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
o AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, i) AS r FROM w),
c AS (SELECT doc_id, list_distinct(flatten(list([i, i + 1, i + 2]))) AS gone FROM o WHERE r > 1 GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(len(string_split(documents.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN sha256(documents.text) ELSE
    sha256(array_to_string([d.l[i] FOR i IN range(1, len(d.l) + 1) IF NOT list_contains(gone, i)], chr(10))) END AS kept_sha256
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id LEFT JOIN c ON documents.doc_id = c.doc_id
"""

def op3_substrings(spark, sf_dir):
    x = substring.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
o AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM o) WHERE n > 1),
p AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT p.doc_id, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

def op5_lm(spark, sf_dir):
    x = lm.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_tokens", F.round("lm_score", 6).alias("lm_score"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS l FROM documents),
t AS (SELECT doc_id, i, l[i] AS w, CASE WHEN i >= 2 THEN l[i-1] END AS v, CASE WHEN i >= 3 THEN l[i-2] END AS u FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
g AS (SELECT doc_id, 1 AS n, w AS g FROM t UNION ALL SELECT doc_id, 2, v || ' ' || w FROM t WHERE v IS NOT NULL UNION ALL SELECT doc_id, 3, u || ' ' || v || ' ' || w FROM t WHERE u IS NOT NULL),
own AS (SELECT doc_id, n, g, count(*) AS c FROM g GROUP BY doc_id, n, g),
c AS (SELECT doc_id, n, g, sum(c) OVER (PARTITION BY n, g) - c AS c FROM own),
s AS (SELECT doc_id, len(l) AS k, (SELECT sum(len(l)) FROM d) - len(l) AS rest FROM d),
j AS (SELECT t.doc_id, i, CASE WHEN w1.c > 0 THEN w1.c / s.rest ELSE 1 / (s.rest + 1) END AS s1, c2.c AS c2, v1.c AS v1, c3.c AS c3, h2.c AS h2
  FROM t JOIN s ON t.doc_id = s.doc_id
  JOIN c AS w1 ON w1.n = 1 AND w1.doc_id = t.doc_id AND w1.g = w
  LEFT JOIN c AS v1 ON v1.n = 1 AND v1.doc_id = t.doc_id AND v1.g = v
  LEFT JOIN c AS c2 ON c2.n = 2 AND c2.doc_id = t.doc_id AND c2.g = v || ' ' || w
  LEFT JOIN c AS h2 ON h2.n = 2 AND h2.doc_id = t.doc_id AND h2.g = u || ' ' || v
  LEFT JOIN c AS c3 ON c3.n = 3 AND c3.doc_id = t.doc_id AND c3.g = u || ' ' || v || ' ' || w),
k AS (SELECT doc_id, CASE WHEN c3 > 0 THEN c3 / h2 ELSE (CASE WHEN i >= 3 THEN 0.4::DOUBLE ELSE 1 END) *
    (CASE WHEN c2 > 0 THEN c2 / v1 ELSE (CASE WHEN i >= 2 THEN 0.4::DOUBLE ELSE 1 END) * s1 END) END AS p FROM j)
SELECT s.doc_id, CAST(max(s.k) AS BIGINT) AS n_tokens, round(avg(ln(p)), 6) AS lm_score FROM s LEFT JOIN k ON s.doc_id = k.doc_id GROUP BY s.doc_id
"""

def op1_ngram_join(spark, sf_dir):
    x = ngram_join.ngram_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return x.select("doc_id", "n_shingles", "component_id", "class_id")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.z = e.x),
q AS (SELECT doc_id, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS k FROM s GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(q.n, 0) AS BIGINT) AS n_shingles, (SELECT min(z) FROM r WHERE r.doc_id = documents.doc_id) AS component_id,
  CASE WHEN q.k IS NULL THEN documents.doc_id ELSE min(documents.doc_id) OVER (PARTITION BY q.k) END AS class_id
FROM documents LEFT JOIN q ON q.doc_id = documents.doc_id
"""

def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id", 4, 2))
    net = langid.train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()), "text", "lang")
    return langid.identify(docs.select("doc_id", "text", "held_out"), net).select("doc_id", "held_out", "lang_pred", "score")


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out("doc_id", 5, 0))
    labelled = docs.where(~F.col("held_out")).withColumn("lot", quality.lot(F.col("text"))).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    scorer = quality.train(labelled, "text", "quality", quality.word_vectors(docs), "lot")
    return quality.score(docs, scorer).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontaminate(spark, sf_dir):
    x = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "at")


def op6_licenses(spark, sf_dir):
    x = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.size("sentence_ids").alias("n_sentences"), F.array_join("licences", ",").alias("licences"))


def op7_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ann.top_neighbours(rows, rows.where("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score")


def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), misspell=97)


#: CRC-32 in SQL: the table of its bytes, and the fold over a string's.
CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(string: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, where ``t`` is the table."""
    hex = f"hex(encode({string}))"
    code = f"list_transform(range(CAST(len({hex}) / 2 AS BIGINT)), lambda i: CAST('0x' || substr({hex}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {code}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM d GROUP BY doc_id, w),
h AS (SELECT w, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM c, crc),
m AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT DISTINCT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM k a JOIN k b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, k.n, v.word, v.n FROM k JOIN v ON k.cut = v.word
  UNION SELECT v.word, v.n, k.word, k.n FROM k JOIN v ON k.cut = v.word),
b AS (SELECT a AS word, na AS n, count(*) AS n_near, arg_min(b, struct_pack(m := -nb, w := encode(b))) AS near, max(nb) AS m FROM p GROUP BY a, na),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
r(word, z, form) AS (SELECT word, word, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.form = f.word)
SELECT f.word, f.form, r.z AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL
"""


def op12_resample(spark, sf_dir):
    x = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=1)
    return x.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH {CRC_SQL},
x AS (SELECT 's' AS kind, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
w AS (SELECT kind, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM x),
n AS (SELECT kind, doc_id, w, count(*) AS n FROM w GROUP BY kind, doc_id, w),
v AS (SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM n), crc),
f AS (SELECT kind, doc_id, bucket, sum(n) AS n FROM n JOIN v ON n.w = v.w GROUP BY kind, doc_id, bucket),
c AS (SELECT bucket, sum(CASE WHEN kind = 's' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN kind = 't' THEN n ELSE 0 END)::DOUBLE AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS gain FROM c),
d AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM f JOIN g ON f.bucket = g.bucket WHERE kind = 's' GROUP BY doc_id),
q AS (SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST('0x' || left(sha256('2024:' || documents.doc_id), 8) AS BIGINT) AS h FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM q),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM e) THEN rank END AS rank FROM z LEFT JOIN e ON z.doc_id = e.doc_id
"""


def op13_tokens(spark, sf_dir):
    folder = shared_dir(spark)
    tokens.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return tokens.read_tokens(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op11_spelling": op11_spelling, "op12_resample": op12_resample, "op13_tokens": op13_tokens, "op7_neighbours": op7_neighbours, "op2_decontaminate": op2_decontaminate, "op6_licenses": op6_licenses, "op9_language": op9_language, "op10_quality": op10_quality, "op1_ngram_join": op1_ngram_join, "op5_lm": op5_lm, "op3_substrings": op3_substrings, "op4_mix": op4_mix, "op8_lines": op8_lines}
ORACLES = {"op11_spelling": OP11_SQL, "op12_resample": OP12_SQL, "op6_licenses": licenses.scan_sql(), "op1_ngram_join": OP1_SQL, "op5_lm": OP5_SQL, "op3_substrings": OP3_SQL, "op4_mix": OP4_SQL, "op8_lines": OP8_SQL}

"""The contract queries of the operators and the SQL that states them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquest.llm import op1_pii, op2_embeddings, op3_shard, op4_mix, op5_substring, op6_pieces, op7_quality, op8_license, op9_simhash, op10_tokens, op11_runs, op12_counts
from loomquest.llm.common import new_path, rows_of, saved, sealed, words


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op1_pii.found(rows_of(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == op1_pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[n(k) for k in op1_pii.BASE], F.sha2(op1_pii.shown(F.col("base")), 256).alias("base_sha256"), op1_pii.shown(F.col("spans")).alias("spans"))


def op2_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_embeddings.linked(rows_of(spark, sf_dir, "embeddings"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents")
    d = op3_shard.sharded(docs.select("doc_id", "text").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mix_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mix.mixed(rows_of(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_anchor_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op5_substring.deduped(rows_of(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op6_pieces.encoded(rows_of(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"])
    return d.select("doc_id", "n_pieces", "ids_crc32", "score", "nbest", "nbest_crc32", "exact")


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    m = saved(op7_quality.measures(rows_of(spark, sf_dir, "documents")).select(*thin), "measures")
    d = op7_quality.with_verdicts(m, op7_quality.host_verdicts(m))
    return d.select(*[c for c in thin if c != "source"], "kept", F.round("host_rate", 9).alias("host_rate"))


def op8_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op8_license.scanned(rows_of(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op9_simhash.grouped(rows_of(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    index = op10_tokens.write_ids(rows_of(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path("word_bpe_49k.json"))
    return op10_tokens.read_ids(index, path, with_ids=False).select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by their ids, first repeat words from some place on. A null id is none of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = rows_of(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("words"), (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    d = sealed(d, ["words", "chosen", "g"]).withColumn("n", F.size("words").cast("long"))
    d = d.withColumn("a", F.when(F.col("chosen") & (F.col("n") > 0), F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    d = sealed(d, ["words", "a", "p"])
    again = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    d = op11_runs.found(d, ["doc_id"], F.when(F.col("a").isNull(), F.col("words")).otherwise(again))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "kept")
    return d.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), "best.length", (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = op12_counts.counted(rows_of(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"])
    return d.withColumn("over_limit", F.col("n_tokens") > 4096)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_boosting, op2_embedding_itq, op3_histogram_sort, op4_mix_budgets, op5_anchor_substrings, op6_nbest_pieces, op7_host_quality, op8_license_join, op9_simhash_mih, op10_packed_ids,
        op11_periodic_runs, op12_token_counts,
    )
}

_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_SIZE = f"CAST(len({_W}) AS BIGINT)"
_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _place(phrase: list[str]) -> str:
    return "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase)) + ")"


_TEMPLATES = ", ".join(f"('{label}', {_list(own)})" for label, own in op8_license.parts(op8_license.TEMPLATES))
_OWN = ", ".join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for label in op8_license.PHRASES)

ORACLE_SQL = {
    # Every pair is compared; the query's retrieval finds all links of these tables.
    "op2_embedding_itq": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {op2_embeddings.THRESHOLD}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT vec_id, least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links FROM v)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op5_anchor_substrings": f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM i),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) < doc_id AS late FROM x),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM f, (SELECT unnest(range(0, 50)) AS j) WHERE late),
h AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM h)),
k AS (SELECT doc_id, coalesce(string_agg(w[p], ' ' ORDER BY p), '') AS kept FROM u ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN h.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op8_license_join": f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
p AS (SELECT doc_id, w, {', '.join(f'{_place(p)} AS {label}' for label, p in op8_license.PHRASES.items())} FROM d),
b AS (SELECT doc_id, unnest(range(0, greatest(1, len(w)), {op8_license.STEP})) AS pos, w FROM d),
t(label, own) AS (VALUES {_TEMPLATES}),
m AS (SELECT doc_id, label, len(list_intersect(list_slice(w, pos + 1, pos + {op8_license.BLOCK}), own)) / len(own) AS share FROM b, t),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM m WHERE share >= {op8_license.THRESHOLD} - 1e-9 GROUP BY doc_id),
s AS (SELECT *, flatten([{', '.join(op8_license.PHRASES)}]) AS starts, list_filter([{_OWN}], lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) - 1 AS BIGINT) AS first_word, CAST(list_max(starts) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(f.labels, [])))), ',') AS labels,
  CASE WHEN len(starts) > 0 THEN 1.0::DOUBLE ELSE coalesce(f.share, 0.0)::DOUBLE END AS score
FROM s LEFT JOIN f USING (doc_id)""",
    "op4_mix_budgets": f"""
WITH d AS (SELECT doc_id, source, {_SIZE} AS size, md5('20:' || doc_id) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM r) - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / CAST((SELECT sum(w) FROM r) - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM r WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(CAST(cap AS DOUBLE), w * (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, level LIMIT 1)) AS target FROM l),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target) / source_size) * size + greatest(0, least(size, floor(target) - floor(floor(target) / source_size) * source_size - start)) END AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source""",
    "op7_host_quality": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_W} AS w FROM documents),
wins AS (SELECT DISTINCT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS win FROM wins),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM keyed) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT doc_id, source, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM b GROUP BY source),
s AS (SELECT avg(failed / n) AS mean, coalesce(var_samp(failed / n), 0) AS v FROM h),
k AS (SELECT mean, greatest(1.0, CASE WHEN v > 0 AND v < mean * (1 - mean) THEN mean * (1 - mean) / v - 1 ELSE 1.0 END) AS strength FROM s),
r AS (SELECT source, (failed + mean * strength) / (n + strength) AS host_rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rate > 0.9 AS kept, round(host_rate, 9) AS host_rate
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source""",
    "op11_periodic_runs": f"""
WITH c AS (SELECT doc_id, {_W} AS o, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)) AS b FROM documents),
h AS (SELECT doc_id, o, len(o) AS n, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda s, x: list_reduce(list_concat([xor(s, x)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) AS h FROM c),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN h // 10 % n ELSE n END AS a, 3 + h // 10 % 8 AS k FROM h),
d AS (SELECT doc_id, n, list_transform(range(0, n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END + 1]) AS w FROM g),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 6), ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM d WHERE n >= 12)),
m AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.s = r.s AND l.i < r.i),
e AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM m),
t AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM e GROUP BY doc_id, q, isle HAVING count(*) + 5 >= q AND count(*) + 5 + q >= 12),
r AS (SELECT doc_id, start, length, min(q) AS q FROM t GROUP BY doc_id, start, length),
s AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'start': start, 'length': length, 'q': q}}, (length, -start, -q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY doc_id),
z AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(start + q, start + length)) AS p FROM r) GROUP BY doc_id),
u AS (SELECT doc_id, w, unnest(range(0, n)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM z)),
k AS (SELECT doc_id, string_agg(w[p + 1], ' ' ORDER BY p) AS kept FROM u ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM z) USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best['start'] AS BIGINT) AS start, CAST(best['length'] AS BIGINT) AS length, CAST(best['q'] AS BIGINT) AS period,
  CAST(1000 * best['length'] // best['q'] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(CASE WHEN n_runs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS collapsed_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)""",
}

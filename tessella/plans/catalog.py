"""Registered queries and their oracle SQL.

``SHARED`` texts run on both engines; ``_PLANS`` are DataFrame plans with an
oracle of their own where SQL can express them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, dedup, evaluate, logs, near, packing
from ..sources import readers
from ..stage import materialize, row_numbers, running_total
from ..streaming import tail
from . import more

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARED = {
    "agg_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "join_revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "semi_join_orders": "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "anti_join_customers": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "left_join_defaults": "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "full_outer_alignment": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NULL AS missing_left, l.doc_id IS NULL AS missing_right FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id",
    "report_grouping_sets": "SELECT source, lang, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY GROUPING SETS ((source), (lang), (source, lang), ())",
    "rollup_region": "SELECT r_name, n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "cube_events": "SELECT event_type, user_id % 4 AS shard, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 4)",
    "conditional_count": "SELECT source, count(CASE WHEN n_chars >= 1000 THEN 1 END) AS long_docs, count(CASE WHEN n_chars < 1000 THEN 1 END) AS short_docs, min(coalesce(nullif(n_chars, 0), 1)) AS least FROM documents GROUP BY source",
    "mean_chars": "SELECT source, round(sum(n_chars) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS mean_chars FROM documents GROUP BY source",
    "top_k_per_group": "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) x WHERE rn <= 3",
    "order_limit": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25",
    "argmax_by_category": "SELECT lang, max_by(doc_id, n_chars * 10000000 + doc_id) AS doc_id FROM documents GROUP BY lang",
    "set_union": "SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels",
    "set_except": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "set_intersect": "SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels WHERE quality = 1",
    "id_dedup": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) x WHERE rn = 1",
    "moving_avg": "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5 FROM events",
    "last_write_wins": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1",
    "lag_delta": "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events",
    "segments": "SELECT user_id, segment, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM events) x GROUP BY user_id, segment",
    "natural_mixture": "SELECT lang, round(sum(n_chars) / CAST(sum(sum(n_chars)) OVER () AS DOUBLE), 6) AS share FROM documents GROUP BY lang",
    "mixture_weights": "SELECT lang, round(least(greatest(0.25 / (sum(n_chars) / CAST(sum(sum(n_chars)) OVER () AS DOUBLE)), 0.01), 100), 4) AS weight, CAST(1000000 - sum(n_chars) AS BIGINT) AS gap FROM documents GROUP BY lang",
    "stride_downsample_users": "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) x WHERE rn % 5 = 0",
    "ratio_pairs": "SELECT conv_id, round(max(CASE WHEN role = 'assistant' THEN length(text) END) / CAST(nullif(max(CASE WHEN role = 'user' THEN length(text) END), 0) AS DOUBLE), 6) AS ratio FROM conversations GROUP BY conv_id",
    "fixed_rotation": "SELECT doc_id, doc_id % 7 AS slot FROM documents WHERE doc_id % 7 = 3",
    "correlated_max": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "ranking": "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS quartile FROM customer",
    "title_classifier": "SELECT page_id, CASE WHEN url LIKE '%/de/%' THEN 4 WHEN url LIKE '%/fr/%' THEN 3 WHEN url LIKE '%/es/%' THEN 2 WHEN url LIKE '%spam%' THEN 5 ELSE 1 END AS category FROM pages",
    "retention_newest": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn <= 3",
    "duplicate_ids": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 2",
    "time_lookback": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n_hour FROM events",
    "event_kind_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS med, round(max(value), 6) AS top FROM events GROUP BY event_type",
}


def _shared(name: str):
    def run(spark, sf_dir):
        for t in TABLES:
            if t in SHARED[name]:
                _t(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(SHARED[name])
    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents in and kept, paragraphs dropped, characters removed."""
    cleaned = corpus.clean(_t(spark, sf_dir, "documents").select("doc_id", "source", "text").repartition(spark.sparkContext.defaultParallelism * 2))
    # Cleaned text is made once before the rules look at it, and rules once before the branches.
    docs = materialize(corpus.quality_cascade(materialize(cleaned)))
    kept = materialize(corpus.dedup_documents(docs.where("reason is null"), ["doc_id"]).where("owner = doc_id"))
    paras = corpus.dedup_paragraphs(kept)
    gone = paras.where("owner <> doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("paras_dropped"), F.sum(F.length("para")).alias("chars_removed"))
    total = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs_in"))
    n = kept.groupBy("source").agg(F.count(F.lit(1)).alias("docs_kept"))
    return total.join(n, "source", "left").join(gone, "source", "left").select("source", "docs_in", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs_kept", "paras_dropped", "chars_removed")])


def _docs(f):
    return lambda spark, sf_dir: f(_t(spark, sf_dir, "documents"))


def _quality(docs):
    return corpus.quality_cascade(docs).select("doc_id", F.length("text").alias("n"), F.round(T.letter_ratio(F.col("text")), 6).alias("letters"), F.round(T.symbol_ratio(F.col("text")), 6).alias("symbols"), "reason")


def _pairs(docs):
    return corpus.window_pairs(corpus.dedup_documents(docs, ["doc_id"]).where("owner = doc_id"), 2)


def _jaccard(docs):
    kept = corpus.dedup_documents(docs, ["doc_id"]).where("owner = doc_id")
    return corpus.pair_jaccard(kept, _pairs(docs))


def _split(docs):
    return corpus.split_with_coverage(docs, F.concat_ws("::", "source", F.col("doc_id").cast("string")), F.concat("source", F.lit("/"), (F.col("doc_id") % 5).cast("string")), F.col("lang"), F.col("n_chars"))


def _asof(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return logs.asof_forward(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "next_purchase").select("event_id", "next_purchase")


def _rollback(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("step", F.col("event_id") % 97)
    return logs.rollback(e, ["user_id"], "event_id", "step", F.col("event_type") == "error").select("event_id", "user_id", "step")


def _minmax(spark, sf_dir):
    return logs.minmax_downsample(_t(spark, sf_dir, "events").withColumn("key", F.col("user_id") % 10), ["key"], "event_id", "value", 20)


def _tokens(docs):
    return docs.select("source", "doc_id", F.size(F.filter(F.split("text", r"[\s]+"), lambda w: w != "")).cast("long").alias("tokens"))


def _chars(docs):
    return docs.select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ch").limit(200)


def _chunk(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "value"), "doc_id").select("file", (F.col("doc_id") * 1000000 + F.col("pos")).alias("line_no"), "value")
    return readers.line_chunks(lines).select("file", "chunk", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


def _nucleus(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("logit"), "token")
    p = v.withColumn("rn", F.row_number().over(w)).where("rn <= 20").withColumn("p", F.exp("logit") / F.sum(F.exp("logit")).over(Window.partitionBy("vec_id")))
    return p.withColumn("before", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("before is null or before < 0.5").select("vec_id", "token", F.col("rn").cast("long").alias("rn"))


def _sketch(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"))
    add = lambda a, b: a + b
    sums = e.select("label", F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), add).alias("rr"), F.aggregate("x", F.lit(0.0), add).alias("s"))
    return sums.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rr"), 3).alias("rr"), F.round(F.sum("s"), 3).alias("s"))


def _four_grams(docs):
    """One row a document; fewer than 5 characters (or no text) give null."""
    return docs.select("doc_id", evaluate.distinct_ratio(F.col("text")).alias("ratio"))


def _losers(docs):
    kept = materialize(corpus.dedup_documents(docs.select("doc_id", "source", "text"), ["doc_id"]).where("owner = doc_id").drop("owner"))
    # All priorities are equal, so only pairs from ``same`` on are dropped.
    return dedup.greedy_drops(dedup.judge_pairs(near.similar_pairs(kept, 0.99), kept, []))


def _stream(spark, sf_dir):
    return tail.run_once(tail.tumbling(tail.event_stream(spark, sf_dir)), "tumbling_events")


def _profile(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    rows = docs.select(F.expr("stack(3, 'text', text, 'lang', lang, 'source', source) as (field, value)"))
    # Quantiles of lengths from (length, count) rows, so no field's values meet in one list.
    counts = rows.where("value <> ''").groupBy("field", F.length("value").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("field")
    c = counts.withColumn("upto", F.sum("c").over(w.orderBy("len"))).withColumn("n", F.sum("c").over(w))
    q = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col("len"))).cast("long")
    return c.groupBy("field").agg(F.max("n").alias("n"), F.sum(F.col("len") * F.col("c")).alias("total"), F.min("len").cast("long").alias("least"), F.max("len").cast("long").alias("most"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"))


_PLANS = {
    "stride_downsample": lambda spark, sf_dir: row_numbers(_t(spark, sf_dir, "events").select("event_id", "ts"), [], ["ts", "event_id"]).where("(rn - 1) % 40 = 0").select("event_id"),
    "cumulative_tokens": _docs(lambda d: running_total(d.select("doc_id", "lang", "n_chars"), ["lang"], ["doc_id"], F.col("n_chars"), "upto").select("doc_id", "lang", "upto")),
    "flagship": flagship,
    "quality_cascade": _docs(_quality),
    "quarantine_by_reason": _docs(lambda d: corpus.quality_cascade(d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))),
    "norm_text": _docs(lambda d: corpus.clean(d).select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))),
    "dedup_exact_doc": _docs(lambda d: corpus.dedup_documents(d, ["doc_id"]).select("doc_id", "owner")),
    "dedup_exact_para": _docs(lambda d: corpus.dedup_paragraphs(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paras"), F.count_if(F.col("owner") != F.col("doc_id")).alias("dropped"))),
    "dedup_final_text": _docs(lambda d: corpus.rebuild(corpus.dedup_paragraphs(d), d).select("doc_id", F.md5("final").alias("digest"))),
    "owner_matrix": _docs(lambda d: corpus.dedup_paragraphs(d).where("owner <> doc_id").alias("p").join(d.select(F.col("doc_id").alias("owner"), F.col("source").alias("dup_source")), "owner").groupBy("source", "dup_source").agg(F.sum(F.length("para")).alias("chars"))),
    "window_pairs": _docs(_pairs),
    "pair_jaccard": _docs(_jaccard),
    "neardup_losers": _docs(_losers),
    "decontam_overlap": lambda spark, sf_dir: corpus.window_overlap(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")),
    "split_hash": _docs(lambda d: d.select("doc_id", T.split_of(F.concat_ws("::", "source", F.col("doc_id").cast("string"))).alias("split"))),
    "split_coverage": _docs(_split),
    "html_fields": lambda spark, sf_dir: readers.html_fields(_t(spark, sf_dir, "pages")),
    "chunk_100_lines": _chunk,
    "char_freq_topk": _docs(_chars),
    "field_profile": _profile,
    "token_stats": _docs(lambda d: _tokens(d).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))),
    "asof_forward": _asof,
    "rollback": _rollback,
    "minmax_downsample": _minmax,
    "shard_offsets": _docs(lambda d: packing.shard_offsets(_tokens(d), 20000)),
    "shard_validate": _docs(lambda d: packing.validate_shards(packing.shard_offsets(_tokens(d), 20000))),
    "lr_schedule": lambda spark, sf_dir: spark.range(55200, 244141, 997).select(F.col("id").alias("step"), F.round(logs.learning_rate(F.col("id"), logs.cycle_edges(55200, 244141, 3), 1000, 3.60865e-5, 1e-4, 1e-5), 12).alias("lr")),
    "nucleus_topk": _nucleus,
    "similarity_sketch": _sketch,
    "distinct_4gram": _docs(_four_grams),
    "stream_tumbling": _stream,
}

_W = "list_distinct(list_concat(regexp_extract_all(text, '(?s).{24}'), regexp_extract_all(substr(text, 9), '(?s).{24}'), regexp_extract_all(substr(text, 17), '(?s).{24}')))"
_LETTERS = r"CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[\p{L}]', '', 'g'))) / length(text)::DOUBLE ELSE 0.0 END"
_SYMBOLS = r"""CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[^\p{L}\p{N}_\s.,;:!?''"()\-]', '', 'g'))) / length(text)::DOUBLE ELSE 0.0 END"""
_REASON = f"CASE WHEN length(text) < 50 THEN 'too_short' WHEN {_LETTERS} < 0.55 THEN 'low_letters' WHEN {_SYMBOLS} > 0.25 THEN 'symbols' WHEN regexp_matches(text, 'http://|www\\.') THEN 'url' END"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]', '', 'g'), '[ \t\x{3000}]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '^[ \t\x{{3000}}\n]+|[ \t\x{{3000}}\n]+$', '', 'g')"
_PARAS = r"p AS (SELECT doc_id, source, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> '')) AS para, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> ''), 1) AS pos FROM {docs}), o AS (SELECT para, min(doc_id) AS owner FROM p GROUP BY para), q AS (SELECT p.*, owner FROM p JOIN o USING (para))"
_UNIQUE = "u AS (SELECT * FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text))"
_PAIRS = f"w AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest({_W}) AS g FROM u) WHERE sha1(g)[16:16] = '0'), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM w x JOIN w y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2)"
_BUCKET = "(('0x' || sha256('42:' || source || '::' || doc_id)[1:8])::BIGINT % 1000)"
_SPLIT = f"CASE WHEN {_BUCKET} < 5 THEN 'test' WHEN {_BUCKET} < 15 THEN 'val' ELSE 'train' END"
_SIX = "list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(substr(text, {1 + k}), '(?s).{{24}}')" for k in range(0, 24, 4)) + "))"

_ORACLES = {
    "stride_downsample": "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events) x WHERE rn % 40 = 0",
    "cumulative_tokens": "SELECT doc_id, lang, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS upto FROM documents",
    "quality_cascade": f"SELECT doc_id, length(text) AS n, round({_LETTERS}, 6) AS letters, round({_SYMBOLS}, 6) AS symbols, {_REASON} AS reason FROM documents",
    "quarantine_by_reason": f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
    "norm_text": f"SELECT doc_id, md5({_CLEAN}) AS digest, length({_CLEAN}) AS n FROM documents",
    "flagship": f"WITH d AS (SELECT doc_id, source, {_CLEAN} AS text FROM documents), k AS (SELECT * FROM d WHERE ({_REASON}) IS NULL AND doc_id IN (SELECT min(doc_id) FROM d WHERE ({_REASON}) IS NULL GROUP BY text)), {_PARAS.replace('{docs}', 'k')}, g AS (SELECT source, count(*) AS paras_dropped, sum(length(para)) AS chars_removed FROM q WHERE owner <> doc_id GROUP BY source) SELECT source, docs_in, coalesce(docs_kept, 0) AS docs_kept, coalesce(paras_dropped, 0) AS paras_dropped, coalesce(chars_removed, 0)::BIGINT AS chars_removed FROM (SELECT source, count(*) AS docs_in FROM d GROUP BY source) LEFT JOIN (SELECT source, count(*) AS docs_kept FROM k GROUP BY source) USING (source) LEFT JOIN g USING (source)",
    "dedup_exact_doc": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner FROM documents",
    "dedup_exact_para": f"WITH {_PARAS.replace('{docs}', 'documents')} SELECT doc_id, count(*) AS paras, count(*) FILTER (WHERE owner <> doc_id) AS dropped FROM q GROUP BY doc_id",
    "dedup_final_text": f"WITH {_PARAS.replace('{docs}', 'documents')} SELECT d.doc_id, md5(coalesce(string_agg(para, chr(10) ORDER BY pos) FILTER (WHERE owner = d.doc_id), '')) AS digest FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id GROUP BY d.doc_id",
    "owner_matrix": f"WITH {_PARAS.replace('{docs}', 'documents')} SELECT q.source, d.source AS dup_source, sum(length(para))::BIGINT AS chars FROM q JOIN documents d ON d.doc_id = owner WHERE owner <> q.doc_id GROUP BY 1, 2",
    "window_pairs": f"WITH {_UNIQUE}, {_PAIRS} SELECT * FROM c ORDER BY c DESC, a, b LIMIT 12000",
    "pair_jaccard": f"WITH {_UNIQUE}, {_PAIRS}, s AS (SELECT doc_id, {_SIX} AS x FROM u), t AS (SELECT * FROM c ORDER BY c DESC, a, b LIMIT 12000) SELECT a, b, c, round(len(list_intersect(m.x, n.x)) / (len(m.x) + len(n.x) - len(list_intersect(m.x, n.x)))::DOUBLE, 6) AS similarity FROM t JOIN s m ON m.doc_id = a JOIN s n ON n.doc_id = b",
    "decontam_overlap": f"WITH w AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest({_W}) AS g FROM documents) WHERE sha1(g)[16:16] IN ('0', '1', '2', '3')), b AS (SELECT DISTINCT g FROM (SELECT unnest({_W}) AS g FROM benchmark)) SELECT doc_id, count(*) AS n, count(b.g) AS matched FROM w LEFT JOIN b USING (g) GROUP BY doc_id",
    "split_hash": f"SELECT doc_id, {_SPLIT} AS split FROM documents",
    "split_coverage": f"WITH d AS (SELECT doc_id, source || '/' || (doc_id % 5) AS author, lang AS category, n_chars AS size, {_SPLIT} AS split0 FROM documents), e AS (SELECT *, CASE WHEN split0 <> 'train' AND author IN (SELECT author FROM d WHERE split0 = 'train') THEN 'train' ELSE split0 END AS split1 FROM d), h AS (SELECT category, bool_or(split1 = 'val') AS v, bool_or(split1 = 'test') AS t FROM e GROUP BY category), r AS (SELECT doc_id, row_number() OVER (PARTITION BY category ORDER BY size DESC, doc_id) AS rn FROM e WHERE split1 = 'train') SELECT doc_id, split0, split1, CASE WHEN rn = 1 AND NOT v THEN 'val' WHEN rn = CASE WHEN v THEN 1 ELSE 2 END AND NOT t THEN 'test' ELSE split1 END AS split FROM e JOIN h USING (category) LEFT JOIN r USING (doc_id)",
    "html_fields": r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages""",
    "chunk_100_lines": "WITH l AS (SELECT source AS file, doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, pos) AS rn FROM l WHERE trim(value) <> ''), t AS (SELECT file, (rn - 1) // 100 + 1 AS chunk, string_agg(value, chr(10) ORDER BY rn) AS text FROM k GROUP BY 1, 2) SELECT file, chunk, length(text) AS n, md5(text) AS digest FROM t",
    "char_freq_topk": "SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ch ORDER BY n DESC, ch LIMIT 200",
    "field_profile": "WITH r AS (SELECT 'text' AS field, length(text) AS l FROM documents WHERE text <> '' UNION ALL SELECT 'lang', length(lang) FROM documents WHERE lang <> '' UNION ALL SELECT 'source', length(source) FROM documents WHERE source <> ''), s AS (SELECT field, count(*) AS n, sum(l)::BIGINT AS total, min(l) AS least, max(l) AS most, list_sort(list(l)) AS v FROM r GROUP BY field) SELECT field, n, total, least, most, v[floor(0.5 * (n - 1))::INT + 1] AS p50, v[floor(0.9 * (n - 1))::INT + 1] AS p90, v[floor(0.99 * (n - 1))::INT + 1] AS p99 FROM s",
    "token_stats": r"WITH t AS (SELECT source, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS tokens FROM documents) SELECT source, sum(tokens)::BIGINT AS tokens, max(tokens) AS most FROM t GROUP BY source",
    "asof_forward": "WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, p.event_id AS next_purchase FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts",
    "rollback": "WITH e AS (SELECT *, event_id % 97 AS step, min(CASE WHEN event_type = 'error' THEN event_id % 97 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM events) SELECT event_id, user_id, step FROM e WHERE event_type <> 'error' AND (later IS NULL OR step <= later)",
    "minmax_downsample": "WITH e AS (SELECT event_id, value, user_id % 10 AS key, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id % 10) AS n FROM events), i AS (SELECT *, (rn - 2) * 20 // (n - 2) AS b FROM e WHERE rn > 1 AND rn < n), k AS (SELECT *, row_number() OVER (PARTITION BY key, b ORDER BY value, event_id) AS lo, row_number() OVER (PARTITION BY key, b ORDER BY value DESC, rn) AS hi FROM i) SELECT key, event_id, value FROM k WHERE lo = 1 OR hi = 1 UNION ALL SELECT key, event_id, value FROM e WHERE rn = 1 OR rn = n",
    "lr_schedule": "WITH s AS (SELECT unnest(range(55200, 244141, 997)) AS step), c AS (SELECT step, CASE WHEN step < 118181 THEN 55200 WHEN step < 181161 THEN 118181 ELSE 181161 END AS low, CASE WHEN step < 118181 THEN 118181 WHEN step < 181161 THEN 181161 ELSE 244141 END AS high FROM s) SELECT step, round(CASE WHEN step - 55200 < 1000 THEN 3.60865e-5 + (1e-4 - 3.60865e-5) * (step - 55200) / 999.0::DOUBLE WHEN low = 55200 THEN 1e-5 + 4.5e-5 * (1 + cos(pi() * (step - low - 1000) / (high - low - 1001)::DOUBLE)) ELSE 1e-5 + 4.5e-5 * (1 + cos(pi() * (step - low) / (high - low - 1)::DOUBLE)) END, 12) AS lr FROM c",
    "nucleus_topk": "WITH v AS (SELECT vec_id, unnest(embedding) AS logit, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS rn FROM v), p AS (SELECT *, exp(logit::DOUBLE) / sum(exp(logit::DOUBLE)) OVER (PARTITION BY vec_id) AS p FROM r WHERE rn <= 20), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) SELECT vec_id, token, rn FROM c WHERE before IS NULL OR before < 0.5",
    "similarity_sketch": "SELECT label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 3) AS rr, round(sum(list_sum(list_transform(embedding, lambda v: v::DOUBLE))), 3) AS s FROM embeddings GROUP BY label",
    "distinct_4gram": "WITH big AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '(?s).{4}'), regexp_extract_all(substr(text, 2), '(?s).{4}'), regexp_extract_all(substr(text, 3), '(?s).{4}'), regexp_extract_all(substr(text, 4), '(?s).{4}'))) AS x FROM documents WHERE length(text) > 4), c AS (SELECT doc_id, count(DISTINCT x) AS d, count(*) AS n FROM big GROUP BY doc_id) SELECT d.doc_id, round(c.d / c.n::DOUBLE, 3) AS ratio FROM documents d LEFT JOIN c USING (doc_id)",
    "stream_tumbling": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}


def queries():
    return {n: _shared(n) for n in SHARED} | dict(_PLANS) | more.queries()


def oracle_sql():
    return dict(SHARED) | dict(_ORACLES) | more.oracle_sql()

"""Further registered queries: sources and sinks, cleaning, dedup levels, reports, tokens, logs, evaluation, streams.

``SHARED`` texts run on both engines; ``_PLANS`` are DataFrame plans, most with
an oracle of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import cleaning, corpus, dedup, evaluate, logs, near, packing
from ..sources import formats, readers
from ..stage import lookup, materialize, new_path, running_total
from ..streaming import tail

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The priority of sources in the queries: descending by number, so that it differs from the order of ids.
PRIORITY = [f"src{k}" for k in range(19, -1, -1)]


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(table, f):
    return lambda spark, sf_dir: f(_t(spark, sf_dir, table))


SHARED = {
    "source_selection": "SELECT doc_id, source FROM documents WHERE source IN (SELECT min(source) FROM documents UNION ALL SELECT max(source) FROM documents)",
    "split_counts": "SELECT split, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_chars, CASE WHEN doc_id % 200 = 0 THEN 'test' WHEN doc_id % 100 = 1 THEN 'val' ELSE 'train' END AS split FROM documents) x GROUP BY split",
    "tokens_grouping_sets": "SELECT source, lang, label, CAST(sum(n_chars) AS BIGINT) AS tokens, count(*) AS docs FROM (SELECT d.*, coalesce(l.quality, -1) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x GROUP BY GROUPING SETS ((source), (lang), (label), ())",
    "last_segment_stats": "SELECT e.user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS s FROM events WHERE event_type = 'signup' GROUP BY user_id) b ON e.user_id = b.user_id WHERE b.s IS NULL OR e.event_id >= b.s GROUP BY e.user_id",
    "category_recovery": "SELECT d.doc_id, coalesce(nullif(trim(CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.lang END), ''), b.category, 'unknown') AS category FROM documents d LEFT JOIN (SELECT doc_id, max(source) AS category FROM documents WHERE doc_id % 2 = 0 GROUP BY doc_id) b ON d.doc_id = b.doc_id",
    "known_category": "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')",
    "validation_mean": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) x WHERE rn <= 50 GROUP BY event_type",
    "clip_fraction": "SELECT event_type, round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS clipped, round(max(value), 6) AS most FROM events GROUP BY event_type",
    "line_count": "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents WHERE text <> ''",
    "attempt_marker": "SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events",
    "override_default": "SELECT doc_id, coalesce(CASE WHEN n_chars > 4000 THEN n_chars END, 4000) AS budget FROM documents",
    "perplexity": "SELECT event_id, round(exp(least(value / 10, 20)), 4) AS ppl FROM events",
    "overlap_category": "SELECT a.lang AS lang, b.lang AS dup_lang, CAST(sum(a.n_chars) AS BIGINT) AS chars FROM documents a JOIN (SELECT text, min(doc_id) AS owner FROM documents GROUP BY text) o ON a.text = o.text JOIN documents b ON b.doc_id = o.owner WHERE a.doc_id <> o.owner GROUP BY a.lang, b.lang",
    "md5_key": "SELECT doc_id, substr(md5(text), 1, 16) AS key FROM documents",
    "record_sha1": "SELECT doc_id, sha1(coalesce(source, '') || coalesce(lang, '') || coalesce(text, '')) AS digest FROM documents" ,
    "window_sample_64": "SELECT doc_id FROM documents WHERE substr(md5(text), 16, 1) = '0' AND substr(md5(text), 15, 1) IN ('0', '4', '8', 'c')",
}


def _shared(name):
    def run(spark, sf_dir):
        for t in TABLES:
            if t in SHARED[name]:
                _t(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(SHARED[name].replace("sha1(coalesce(source, '') || coalesce(lang, '') || coalesce(text, ''))", "sha1(concat(coalesce(source, ''), coalesce(lang, ''), coalesce(text, '')))"))
    return run


# ---- sources and sinks: written to the shared folder and read back ----

def _jsonl(spark, sf_dir):
    path = new_path(spark, "jsonl")
    formats.write_jsonl(_t(spark, sf_dir, "documents").select("doc_id", "source", "text"), path)
    return readers.jsonl(spark, path, T.StructType.fromDDL("doc_id long, source string, text string")).select("doc_id", "source", F.md5("text").alias("digest"), "json_error")


def _bad_json(spark, sf_dir):
    path = new_path(spark, "lines")
    d = _t(spark, sf_dir, "documents")
    value = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("{broken "), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct("doc_id", "lang")))
    d.select(value.alias("value")).write.text(path)
    got = readers.jsonl(spark, path, T.StructType.fromDDL("doc_id long, lang string"))
    return got.groupBy(F.col("json_error").isNotNull().alias("bad"), "lang").agg(F.count(F.lit(1)).alias("n"), F.max("json_error").alias("example"))


def _partitioned(spark, sf_dir):
    """Per-source output, then one source rewritten: only that one changes."""
    path, d = new_path(spark, "sources"), _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    formats.write_by_source(d, path)
    formats.rewrite_sources(materialize(spark.read.parquet(path).where("source = 'src3' and doc_id % 3 = 0").select("doc_id", "n_chars", "source")), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _ids(d: DataFrame) -> DataFrame:
    """Small made-up token ids: the bytes of a digest."""
    return d.select("doc_id", "source", F.array(*[F.conv(F.substring(F.md5("text"), 1 + 4 * k, 3), 16, 10).cast("int") for k in range(8)]).alias("ids"))


def _npy(spark, sf_dir):
    path = new_path(spark, "npy")
    d = _ids(_t(spark, sf_dir, "documents"))
    shards = d.groupBy("source").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "ids"))), lambda x: x["ids"])).alias("ids"))
    formats.write_files(formats.to_npy(shards, F.concat("source", F.lit(".npy")), "ids"), path)
    return formats.from_npy(formats.read_files(spark, path, "*.npy")).select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("source"), "n", "max_token", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _records(spark, sf_dir):
    path = new_path(spark, "records")
    d = _ids(_t(spark, sf_dir, "documents")).withColumn("row", F.col("doc_id"))
    formats.write_files(formats.to_records(d, F.concat("source", F.lit(".bin")), "ids"), path)
    got = formats.records(formats.read_files(spark, path, "*.bin"), 8)
    return got.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("source"), "record", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def _index(spark, sf_dir):
    path = new_path(spark, "index")
    d = _t(spark, sf_dir, "documents").where("source = 'src0'").select((F.col("doc_id") % 3).alias("shard"), (F.col("doc_id") * 5000000000).alias("offset"), "n_chars", (F.col("doc_id") % 6 + 1).alias("category"), "doc_id").orderBy("doc_id")
    body = formats.index_bytes([(int(r.shard), int(r.offset), int(r.n_chars), int(r.category)) for r in d.toLocalIterator()], [1 / 6] * 6)
    formats.write_files(spark.createDataFrame([("docs.idx", bytearray(body))], "name string, content binary"), path)
    return formats.index_rows(formats.read_files(spark, path)).drop("path")


def _file_facts(spark, sf_dir):
    path = new_path(spark, "texts")
    files = _t(spark, sf_dir, "documents").where("source = 'src1'").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    formats.write_files(files, path)
    got = formats.read_files(spark, path, "*.txt")
    cached = materialize(formats.identity(got))
    if not formats.same_identity(formats.identity(formats.read_files(spark, path, "*.txt")), cached):
        raise RuntimeError("files changed while they were read")
    return evaluate.manifest(got).join(formats.file_sha256(got), "path").select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "size", "lines", "chars", "sha256")


def _tree(spark, sf_dir):
    path = new_path(spark, "tree")
    d = _t(spark, sf_dir, "documents").where("source = 'src2'")
    formats.write_files(d.select(F.concat(F.col("lang"), F.lit("/"), F.when(F.col("doc_id") % 5 == 0, "._").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content")), path)
    return readers.text_tree(spark, path, "tree").select("doc_id", F.md5("text").alias("digest"))


# ---- dedup levels ----

def _l1(d):
    files = d.select("doc_id", "source", F.encode("text", "UTF-8").alias("content"))
    return dedup.file_exact(files, PRIORITY, PRIORITY[:10])


def _unique(d):
    return materialize(dedup.document_exact(d.select("doc_id", "source", "text", "n_chars"), PRIORITY).where("owner = doc_id").drop("owner"))


def _judged(u):
    return materialize(dedup.judge_pairs(near.similar_pairs(u, 0.3), u, PRIORITY))


def _para_near(d):
    u = _unique(d)
    return dedup.near_paragraphs(_judged(u), u).groupBy("doc_id", "winner").agg(F.count(F.lit(1)).alias("paras"), F.count_if("dropped").alias("dropped"), F.sum("hits").alias("hits"))


def _final(d):
    u = _unique(d)
    l3 = dedup.audit(dedup.paragraph_exact(u, PRIORITY))
    return dedup.final_chars(u, l3).select("doc_id", "chars_final")


def _char_flow(d):
    """Characters in, dropped at each level, and left, by source."""
    l2 = materialize(dedup.document_exact(d, PRIORITY))
    kept = l2.where("owner = doc_id")
    gone = dedup.paragraph_exact(kept.drop("owner"), PRIORITY).where("owner <> doc_id")
    a = l2.groupBy("source").agg(F.sum("n_chars").alias("clean"), F.sum(F.when(F.col("owner") != F.col("doc_id"), F.col("n_chars")).otherwise(0)).alias("l2"))
    b = gone.groupBy("source").agg(F.sum(F.length("para")).alias("l3"))
    return a.join(b, "source", "left").select("source", "clean", "l2", F.coalesce("l3", F.lit(0)).cast("long").alias("l3"), (F.col("clean") - F.col("l2") - F.coalesce("l3", F.lit(0))).alias("final"))


def _split(d):
    return d.withColumn("split", F.when(F.col("doc_id") % 20 == 0, "test").when(F.col("doc_id") % 20 == 1, "val").otherwise("train"))


def _authors(d):
    a = _split(d).withColumn("author", F.concat(F.lit("w"), (F.col("doc_id") % 777).cast("string"), F.lit("、 w"), (F.col("doc_id") % 55 + 1000).cast("string")))
    return dedup.author_disjoint(a)


# ---- tokens ----

def _tokens(d):
    return d.select("doc_id", "source", "lang", F.size(F.filter(F.split("text", r"[\s]+"), lambda w: w != "")).cast("long").alias("tokens"))


def _lookup(d):
    t = _tokens(d).where("tokens > 0")
    cum = running_total(t, ["lang"], ["doc_id"], F.col("tokens"), "high").withColumn("low", F.col("high") - F.col("tokens"))
    draws = t.sparkSession.range(200).select(F.col("id").alias("draw"), F.lit("en").alias("lang"), (F.col("id") * 37).alias("position"))
    return packing.position_lookup(cum.select("lang", "doc_id", "low", "high"), draws, 256, ["lang"]).select("draw", "doc_id", (F.col("position") - F.col("low")).alias("start"))


def _sequential(d):
    ids = d.select("lang", "doc_id", F.slice(F.transform(F.filter(F.split("text", r"[\s]+"), lambda w: w != ""), lambda w: F.length(w) + 10), 1, 40).alias("tokens"))
    return packing.pack_sequential(ids, ["lang"], 63).select("lang", "row", F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("digest"))


def _sampled(d):
    docs = _tokens(d).select("doc_id", F.col("lang").alias("category"), F.col("tokens").alias("length"))
    got = packing.pack_sampled(docs, {"en": 0.5, "de": 0.3, "xx": 0.2}, 200, 255, 7)
    return got.groupBy("row").agg(F.sum(F.col("take") + F.col("eod").cast("long")).alias("filled"), F.count_if(~F.col("category").isin("en", "de")).alias("others"))


def _validate(d):
    return packing.validate_shards(packing.shard_offsets(_tokens(d), 20000), 20000)


def _coverage(d):
    s = packing.shard_offsets(_tokens(d), 20000).where("source = 'src4'")
    r = s.select("shard", F.when(F.col("doc_id") % 7 == 0, F.col("offset") + 1).otherwise(F.col("offset")).alias("offset"), "tokens", F.row_number().over(Window.partitionBy("source").orderBy("shard", "offset")).alias("line"))
    info = s.groupBy("shard").agg(F.sum("tokens").alias("tokens"), F.lit(40000).alias("max_token"))
    return packing.check_coverage(r, info).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- logs and series ----

def _e(spark, sf_dir):
    return _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _asof_back(spark, sf_dir):
    e = _e(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    return logs.asof_backward(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "last_purchase").select("event_id", "last_purchase")


def _overflow(spark, sf_dir):
    e = _e(spark, sf_dir)
    retries = e.where("event_type = 'error'").select("user_id", "ts", (F.col("event_id") % 5).alias("attempt"))
    return logs.overflow_events(retries, e.where("event_type <> 'error'").select("user_id", "ts", F.col("event_id").alias("step")), "user_id", "ts", "step", "attempt").drop("last_ts")


def _recent(spark, sf_dir):
    r = logs.recent_windows(_e(spark, sf_dir), "user_id", "event_id", "value", 5)
    return r.select("user_id", *[F.round(c, 6).alias(c) for c in ("mean_last", "mean_before", "median", "p90")], "spikes")


def _progress(spark, sf_dir):
    p = logs.progress(_e(spark, sf_dir).withColumn("tokens", F.col("event_id") * 16384), "user_id", "ts", "event_id", "tokens", 20000)
    return p.select("user_id", F.round("steps_s", 8).alias("steps_s"), F.round("share", 6).alias("share"), F.round("hours_left", 4).alias("hours_left"))


EDGES = [55200, 118181, 181161, 244141]


def _phases(spark, sf_dir):
    s = F.col("id")
    return spark.range(50000, 250000, 501).select(s.alias("step"), logs.phase(s, EDGES, 1000).alias("phase"), logs.cycle_id(s, EDGES).cast("long").alias("cycle"), logs.after_boundary(s, EDGES, 2000).cast("long").alias("restart"), F.round(logs.warmup_cosine(s, 60000, 240000, 3e-4, 3e-5), 12).alias("lr"))


def _alerts(spark, sf_dir):
    """One made-up summary row for each user from its events."""
    g = _e(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("overflows"), F.max(F.unix_timestamp("ts")).alias("last_s"), F.max("value").alias("v"), F.count(F.lit(1)).alias("n"))
    s = g.select("user_id", "last_s", (F.col("last_s") + F.col("user_id") % 1000).alias("now_s"), (F.col("user_id") % 11 == 0).alias("completed"), F.when(F.col("user_id") % 13 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("fatal_lines"),
                 "overflows", (F.col("user_id") % 6).alias("worst_attempt"), F.lit(1).alias("scale_drops"), (F.col("user_id") % 7 / 2.0).alias("grad_median"), (F.col("user_id") % 5).alias("grad_spikes"), (F.col("user_id") % 10 / 100.0).alias("val_rise"),
                 F.when(F.col("user_id") % 2 == 0, 118181).alias("restart"), F.lit(0).alias("save_interval"), F.lit(None).cast("long").alias("checkpoint_s"), F.lit(1.0).alias("sec_per_step"), F.lit(10.0).alias("eta_own"), (F.col("user_id") % 4 + 9.0).alias("eta_said"), (F.col("user_id") % 40 + 0.0).alias("free_gib"))
    return logs.alerts(s).select("user_id", F.array_join("alerts", ",").alias("alerts"), "ok")


# ---- evaluation ----

def _logits(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit"))


def _choose(spark, sf_dir):
    v = _logits(spark, sf_dir)
    hist = v.where("token < 8").select("vec_id", "token")
    got = evaluate.next_tokens(v, "vec_id", 20, 0.5, 0.7, 1.3, hist, [3, 5])
    return got.select("vec_id", "token", F.round("p", 5).alias("p"))


def _greedy(spark, sf_dir):
    v = _logits(spark, sf_dir)
    return evaluate.next_tokens(v, "vec_id", temperature=0, penalty=2.0, history=v.where("token < 16").select("vec_id", "token"), blocked=[17]).select("vec_id", "token")


def _similar(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    got = evaluate.similarity(evaluate.pair_sketch(j, "x", "y"), ["label"], "vec_id")
    return got.select("label", "n", "worst", *[F.round(c, 5).alias(c) for c in ("max_abs", "cosine", "relative_l2", "diff_norm")])


def _vec_mean(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").withColumn("w", F.col("vec_id") % 3 + 1)
    m = evaluate.vector_mean(e, ["label"], "embedding", "w")
    return m.select("label", F.posexplode("mean").alias("pos", "m")).select("label", "pos", F.round("m", 6).alias("m"))


def _outputs(d):
    out = d.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("�"))).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("a�b"), "text")).when(F.col("doc_id") % 13 == 0, "ab" * 30).otherwise(F.col("text")).alias("text"), F.lit("").alias("prompt"),
                   F.when(F.col("doc_id") % 17 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("doc_id") % 7).cast("int"))).alias("ids"), F.when(F.col("doc_id") % 2 == 0, "length").otherwise("eod").alias("stop"))
    return evaluate.output_checks(out.where("text is not null"), [0, 4]).select("doc_id", F.array_join("flags", ",").alias("flags"), F.array_join(F.transform("notes", lambda n: F.split_part(n, F.lit("="), F.lit(1))), ",").alias("notes"))


def _drift(spark, sf_dir):
    l = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality", "toxic")
    return evaluate.drift(l.select("key", F.col("quality").alias("value")), l.where("key % 5 <> 0").select("key", F.when(F.col("key") % 7 == 0, F.lit(None)).otherwise(F.col("quality")).alias("value")))


def _integrity(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("layers."), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 4 == 0, "_sq").otherwise(""))
    saved = e.where("vec_id % 9 <> 0").select(name.alias("name"), F.col("embedding").cast("array<double>").alias("values"))
    want = e.where("vec_id % 10 <> 0").select(name.alias("name"), F.when(F.col("vec_id") % 11 == 0, 63).otherwise(64).alias("size"))
    return evaluate.integrity(saved, want)


def _retained(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("step_tmp"), "event_id")).otherwise(F.concat(F.lit("step_"), F.lpad(F.col("event_id").cast("string"), 8, "0"))).alias("name"))
    return evaluate.retained(e, 3)


def _names(spark, sf_dir):
    parts = F.array(*[F.lit(x) for x in ("embed_tokens.weight", "norm.weight", "layers.3.input_norm.weight", "layers.3.attention.q_proj.weight", "layers.12.mlp.up_proj.weight", "head.bias")])
    n = spark.range(1).select(F.explode(parts).alias("name"))
    return n.select("name", evaluate.tensor_group(F.col("name")).alias("part"), F.when(F.col("name").startswith("layers."), F.split_part("name", F.lit("."), F.lit(2))).otherwise(F.split_part("name", F.lit("."), F.lit(1))).alias("layer"))


def _schema(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), F.col("props").alias("value"))
    return evaluate.schema_keys(lines, 1 << 40).groupBy("file", "key").agg(F.sum("n").alias("n"))


def _payload(spark, sf_dir):
    """Latest point and downsampled history of each of ten runs as one struct."""
    e = _e(spark, sf_dir).withColumn("run", F.col("user_id") % 10)
    few = logs.minmax_downsample(e, ["run"], "event_id", "value", 20).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("history"))
    latest = e.groupBy("run").agg(F.max_by("value", "event_id").alias("latest"), F.max("event_id").alias("step"))
    return lookup(latest, few, "run", "inner").select("run", "step", "latest", F.size("history").cast("long").alias("points"), F.col("history")[0]["event_id"].alias("first"))


def _states(spark, sf_dir):
    said = F.when(F.col("event_type") == "error", "training failed").when(F.col("event_type") == "purchase", "tokens=1 tok/s=2").when(F.col("event_type") == "signup", "target reached").otherwise("note")
    lines = _e(spark, sf_dir).select(F.col("user_id").alias("run"), "ts", said.alias("value"))
    return tail.stale(tail.run_states(lines.groupBy("run", "ts").agg(F.max("value").alias("value"))), "timestamp'2100-01-01'").select("run", "state", "shown", "level")


def _upsert(spark, sf_dir):
    path = new_path(spark, "history")
    tail.upsert_history(tail.event_stream(spark, sf_dir).select("user_id", "event_id", "value"), path, ["user_id"], "event_id")
    return tail.history(spark, path)


def _stream_rollback(spark, sf_dir):
    points = tail.event_stream(spark, sf_dir).select(F.col("event_type").alias("run"), (F.col("event_id") % 977).alias("step"), F.col("value").alias("loss"))
    return tail.run_once(tail.rollback_stream(points), "rollback", "update").select("run")


def _stream_join(spark, sf_dir):
    kind = lambda k: tail.event_stream(spark, sf_dir).where(F.col("event_type") == k)
    return tail.run_once(tail.stream_join(kind("error"), kind("purchase"), "6 hours"), "join", "append")


def _books(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))
    words = _t(spark, sf_dir, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("book"))
    return evaluate.book_match(words, pages)


_PLANS = {
    "jsonl_roundtrip": _jsonl, "jsonl_bad_lines": _bad_json, "sources_rewritten": _partitioned, "npy_shards": _npy, "record_files": _records, "index_file": _index, "file_manifest": _file_facts, "text_tree": _tree,
    "group_concat_by_key": _on("conversations", lambda c: readers.grouped_text(c, ["conv_id"], "turn", "text", "role").select("conv_id", "title", F.md5("text").alias("digest"))),
    "adapted_docs": _on("conversations", lambda c: readers.adapt(c, "chat", F.concat_ws("-", "conv_id", "turn"), F.col("text"), author=F.when(F.col("turn") % 2 == 0, " ").otherwise(F.col("role"))).select("doc_id", "author")),
    "report_json": _on("documents", lambda d: formats.report_json(d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "lang")),
    "ratio_metrics": _on("documents", lambda d: d.select("doc_id", F.round(X.cjk_ratio(F.col("text")), 6).alias("cjk"), F.round(X.letter_ratio(F.col("text")), 6).alias("letters"))),
    "year_gate": _on("documents", lambda d: d.select("doc_id", F.array_join(F.transform(cleaning.years(F.col("text"), "all"), lambda y: y.cast("string")), ",").alias("years"))),
    "publication_gate": _on("documents", lambda d: d.select("doc_id", cleaning.publication_gate(F.concat(F.lit("printed "), (1500 + F.col("doc_id") % 500).cast("string")), F.array((1700 + F.col("doc_id") % 300).cast("int"))).alias("status"), cleaning.era_of(F.array((1700 + F.col("doc_id") % 300).cast("int"))).alias("era"))),
    "text_gate": _on("documents", lambda d: (lambda c, s, r: d.select("doc_id", F.md5(c).alias("digest"), s.alias("status"), r.alias("reason")))(*cleaning.text_gate(F.col("text"), "lorem|admin"))),
    "six_way_class": _on("documents", lambda d: d.select("doc_id", cleaning.first_match(F.substring("text", 1, 40), [("[Qq]u", "4"), ("th", "3"), ("sch", "2"), ("ción|de ", "5"), ("[0-9]", "6")], "1").alias("category"))),
    "path_category": _on("documents", lambda d: d.select("doc_id", cleaning.mapped(F.col("lang"), {"en": "1", "fr": "2"}, "").alias("category"), cleaning.safe_name(F.concat_ws("/", F.lit("a|b"), F.col("lang"))).alias("name"))),
    "title_junk": _on("pages", lambda p: p.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("t")).where(~cleaning.junk_title(F.col("t"), "^The"))),
    "line_filter": _on("documents", lambda d: d.select("doc_id", F.md5(cleaning.filter_lines(F.col("text"), "^(The|De|La) ")).alias("digest"))),
    "marker_cleaner": _on("documents", lambda d: d.select("doc_id", F.md5(cleaning.between_markers(F.concat(F.lit("head\n*** START X ***\nProduced by me\n"), "text", F.lit("\n*** END X *** tail")), r"\*{3} START X \*{3}", r"\*{3} END X \*{3}")).alias("digest"))),
    "punctuation_strip": _on("documents", lambda d: d.select("doc_id", F.length(cleaning.strip_punctuation(F.col("text"))).cast("long").alias("n"))),
    "script_fold": _on("documents", lambda d: d.select("doc_id", F.md5(cleaning.fold_script(F.col("text"), {"é": "e", "ñ": "n", "ü": "u"})).alias("digest"), cleaning.script_class(F.col("text"), {"é": "e", "ñ": "n"}).alias("script"))),
    "byte_guard": _on("documents", lambda d: cleaning.guarded(d.withColumn("chars_raw", F.col("n_chars")), 10.0).select("source", "raw", "stored", "within")),
    "full_cascade": _on("documents", lambda d: cleaning.gate(d.withColumn("parse_status", F.when(F.col("doc_id") % 50 == 0, "error").otherwise("ok")).withColumn("time_status", F.when(F.col("doc_id") % 31 == 0, "reject").otherwise("pass")).withColumn("time_reason", F.lit("late")).withColumn("read_error", F.when(F.col("doc_id") % 41 == 0, "io")).withColumn("post_status", F.when(F.col("doc_id") % 43 == 0, "reject"))).select("doc_id", "reason")),
    "dedup_file_exact": _on("documents", _l1), "dedup_doc_priority": _on("documents", lambda d: dedup.document_exact(d, PRIORITY).select("doc_id", "owner")),
    "dedup_para_audit": _on("documents", lambda d: dedup.audit(dedup.paragraph_exact(d, PRIORITY)).groupBy("doc_id", "dup_of").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))),
    "pair_actions": _on("documents", lambda d: _judged(_unique(d))), "para_near": _on("documents", _para_near), "final_chars": _on("documents", _final), "char_flow": _on("documents", _char_flow),
    "cross_split": _on("documents", lambda d: dedup.cross_split(_split(d))), "split_author_disjoint": _on("documents", _authors),
    "id_dedup_null_kept": _on("conversations", lambda c: dedup.first_by_id(c.select(F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("id"), "conv_id", "turn"), "id", ["turn"])),
    "range_lookup": _on("documents", _lookup), "pack_sequential": _on("documents", _sequential), "pack_sampled": _on("documents", _sampled), "shard_validate": _on("documents", _validate), "shard_coverage": _on("documents", _coverage),
    "mixture": _on("documents", lambda d: packing.mixture(d.select(F.col("lang").alias("category"), F.col("n_chars").alias("length")), {"en": 2.0, "de": 1.0, "xx": 5.0}, "weights").select("category", "tokens", F.round("p", 6).alias("p"))),
    "asof_backward": _asof_back, "overflow_events": _overflow, "recent_windows": _recent, "progress": _progress, "schedule_phase": _phases, "alert_rules": _alerts,
    "field_profile_full": _on("documents", lambda d: evaluate.field_profile(d, ["text", "lang", "source"])), "schema_keys": _schema, "char_sets": _on("documents", lambda d: evaluate.char_counts(d)),
    "char_set_difference": lambda spark, sf_dir: evaluate.char_counts(_t(spark, sf_dir, "documents")).join(evaluate.char_counts(_t(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")).select("ch"), "ch", "left_anti").orderBy(F.desc("n"), "ch").limit(200),
    "overlap_by_source": lambda spark, sf_dir: evaluate.overlap_by_source(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), share=2),
    "duplicate_examples": _on("conversations", lambda c: c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 2").groupBy("n").agg(F.count(F.lit(1)).alias("ids"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("conv_id")), 1, 20), lambda x: x.cast("string")), ",").alias("examples"))),
    "choose_tokens": _choose, "greedy_tokens": _greedy, "similarity_levels": _similar, "vector_mean": _vec_mean, "output_checks": _on("documents", _outputs), "settings_drift": _drift, "integrity_checks": _integrity,
    "retained_names": _retained, "tensor_groups": _names, "dashboard_payload": _payload, "run_states": _states, "book_match": _books,
    "aligned_zip": _on("documents", lambda d: evaluate.aligned(d.select("doc_id", "lang"), d.select("doc_id", "n_chars"), "doc_id")),
    "stream_upsert": _upsert, "stream_rollback": _stream_rollback, "stream_join": _stream_join,
    "stream_sliding": lambda spark, sf_dir: tail.run_once(tail.sliding(tail.event_stream(spark, sf_dir)), "sliding"),
    "stream_sessions": lambda spark, sf_dir: tail.run_once(tail.sessions(tail.event_stream(spark, sf_dir)), "sessions"),
}

_PRIO = "(19 - substr(source, 4)::BIGINT)"
_UNIQUE = f"u AS (SELECT d.* FROM documents d JOIN (SELECT text, arg_min(doc_id, {_PRIO} * 1000000000 + doc_id) AS owner FROM documents GROUP BY text) o ON d.doc_id = o.owner)"
_PARA_LIST = r"list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> '')"
_PARAS = f"p AS (SELECT doc_id, source, n_chars, unnest({_PARA_LIST}) AS para FROM {{docs}}), o AS (SELECT para, arg_min(doc_id, {_PRIO} * 1000000000 + doc_id) AS owner FROM p GROUP BY para), q AS (SELECT p.*, owner FROM p JOIN o USING (para))"
_W = "list_distinct(list_concat(regexp_extract_all(text, '(?s).{24}'), regexp_extract_all(substr(text, 9), '(?s).{24}'), regexp_extract_all(substr(text, 17), '(?s).{24}')))"
_SIX = "list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(substr({{t}}, {1 + k}), '(?s).{{{{24}}}}')" for k in range(0, 24, 4)) + "))"
_SIX = _SIX.replace("{{24}}", "{24}")
_SIXP = _SIX.replace("list_distinct(", "(", 1)
_JUDGED = (f"{_UNIQUE}, w AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest({_W}) AS g FROM u) WHERE sha1(g)[16:16] = '0'), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM w x JOIN w y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2), "
           f"s AS (SELECT doc_id, {_PRIO} AS p, text, {_SIX.replace('{t}', 'text')} AS x FROM u), j AS (SELECT a, b, c, round(len(list_intersect(m.x, n.x)) / (len(m.x) + len(n.x) - len(list_intersect(m.x, n.x)))::DOUBLE, 6) AS similarity, m.p AS pa, n.p AS pb FROM c JOIN s m ON m.doc_id = a JOIN s n ON n.doc_id = b), "
           "k AS (SELECT CASE WHEN pa = pb THEN least(a, b) WHEN pa < pb THEN b ELSE a END AS loser, a, b, c, similarity, pa = pb AS same FROM j), judged AS (SELECT loser, CASE WHEN loser = a THEN b ELSE a END AS winner, c, similarity, same, CASE WHEN similarity >= CASE WHEN same THEN 0.99 ELSE 0.8 END THEN 'drop' WHEN similarity >= 0.3 THEN 'paras' END AS action FROM k WHERE similarity >= 0.3)")
_TOKENS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"
_SPLIT = "CASE WHEN doc_id % 20 = 0 THEN 'test' WHEN doc_id % 20 = 1 THEN 'val' ELSE 'train' END"
_IDS = "[" + ", ".join(f"('0x' || md5(text)[{1 + 4 * k}:{3 + 4 * k}])::INT" for k in range(8)) + "]"
_LETTERS = r"CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[\p{L}]', '', 'g'))) / length(text)::DOUBLE ELSE 0.0 END"
_SYMBOLS = r"""CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[^\p{L}\p{N}_\s.,;:!?''"()\-]', '', 'g'))) / length(text)::DOUBLE ELSE 0.0 END"""
_YEARS = r"list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:18|19|20)\d{2}'), lambda y: y::INT)))"
_GATED = r"regexp_replace(regexp_replace(text, '-\{([^{}]*?)\}-', '\1', 'g'), '<[^>]{1,60}>', '', 'g')"

_ORACLES = {
    "jsonl_roundtrip": "SELECT doc_id, source, md5(text) AS digest, NULL::VARCHAR AS json_error FROM documents",
    "jsonl_bad_lines": "SELECT doc_id % 10 = 0 AS bad, CASE WHEN doc_id % 10 <> 0 THEN lang END AS lang, count(*) AS n, max(CASE WHEN doc_id % 10 = 0 THEN '{broken ' || doc_id END) AS example FROM documents GROUP BY 1, 2",
    "sources_rewritten": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE source <> 'src3' OR doc_id % 3 = 0 GROUP BY source",
    "npy_shards": f"WITH i AS (SELECT source, unnest({_IDS}) AS v FROM documents) SELECT source, count(*) AS n, max(v) AS max_token, sum(v)::BIGINT AS total FROM i GROUP BY source",
    "record_files": f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS record, array_to_string({_IDS}, ',') AS ids FROM documents",
    "index_file": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc, doc_id % 3 AS shard, doc_id * 5000000000 AS \"offset\", n_chars AS length, doc_id % 6 + 1 AS category FROM documents WHERE source = 'src0'",
    "file_manifest": "SELECT doc_id, strlen(text) AS size, length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines, length(text) AS chars, sha256(text) AS sha256 FROM documents WHERE source = 'src1'",
    "text_tree": "SELECT 'tree|' || doc_id || '.txt' AS doc_id, md5(text) AS digest FROM documents WHERE source = 'src2' AND doc_id % 5 <> 0",
    "group_concat_by_key": "SELECT conv_id, arg_max(role, turn) AS title, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> ''), '')) AS digest FROM conversations GROUP BY conv_id",
    "adapted_docs": "SELECT 'chat|' || conv_id || '-' || turn AS doc_id, CASE WHEN turn % 2 <> 0 THEN role END AS author FROM conversations",
    "report_json": "SELECT '{' || string_agg('\"' || lang || '\":{\"docs\":' || n || '}', ',' ORDER BY lang) || '}' AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)",
    "ratio_metrics": rf"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN 1 - length(regexp_replace(text, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}\x{{20000}}-\x{{2a6df}}]', '', 'g')) / length(text)::DOUBLE ELSE 0 END, 6) AS cjk, round({_LETTERS}, 6) AS letters FROM documents",
    "year_gate": f"SELECT doc_id, array_to_string({_YEARS}, ',') AS years FROM documents",
    "publication_gate": "SELECT doc_id, CASE WHEN 1500 + doc_id % 500 <= 1945 OR 1700 + doc_id % 300 <= 1945 THEN 'pass' ELSE 'quarantine' END AS status, CASE WHEN 1700 + doc_id % 300 BETWEEN 1912 AND 1945 THEN 'roc' WHEN 1700 + doc_id % 300 BETWEEN 1840 AND 1911 THEN 'late_qing' WHEN 1700 + doc_id % 300 < 1840 THEN 'ming_qing' ELSE 'unknown' END AS era FROM documents",
    "text_gate": f"WITH c AS (SELECT doc_id, {_GATED} AS t FROM documents), y AS (SELECT doc_id, t, {_YEARS.replace('(text', '(substr(t, 1, 3000) || right(t, 1500)')} AS ys FROM c) SELECT doc_id, md5(t) AS digest, CASE WHEN regexp_matches(t, 'lorem|admin') OR coalesce(list_max(ys) >= 1946, false) THEN 'reject' ELSE 'pass' END AS status, CASE WHEN regexp_matches(t, 'lorem|admin') THEN 'modern' WHEN list_max(ys) >= 1946 THEN 'late_year' WHEN len(list_filter(ys, lambda v: v BETWEEN 1900 AND 1945)) > 0 THEN 'year_evidence' ELSE 'no_year' END AS reason FROM y",
    "six_way_class": "SELECT doc_id, CASE WHEN regexp_matches(substr(text, 1, 40), '[Qq]u') THEN '4' WHEN regexp_matches(substr(text, 1, 40), 'th') THEN '3' WHEN regexp_matches(substr(text, 1, 40), 'sch') THEN '2' WHEN regexp_matches(substr(text, 1, 40), 'ción|de ') THEN '5' WHEN regexp_matches(substr(text, 1, 40), '[0-9]') THEN '6' ELSE '1' END AS category FROM documents",
    "path_category": "SELECT doc_id, CASE lang WHEN 'en' THEN '1' WHEN 'fr' THEN '2' ELSE '' END AS category, 'a_b__' || lang AS name FROM documents",
    "title_junk": "SELECT page_id, t FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages) WHERE trim(t) <> '' AND NOT starts_with(t, 'The') AND length(t) <= 120",
    "line_filter": r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x{0b}\x{85}\p{Z}]+|[\s\x{0b}\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(The|De|La) ')), chr(10))) AS digest FROM documents",
    "marker_cleaner": "SELECT doc_id, md5('head' || chr(10) || chr(10) || array_to_string(list_filter(string_split(text || chr(10), chr(10)), lambda x: NOT regexp_matches(x, '^\\s*Produced by\\b')), chr(10))) AS digest FROM documents",
    "punctuation_strip": r"SELECT doc_id, length(regexp_replace(text, '[\p{P}\s\x{0b}\x{85}\p{Z}]+', '', 'g')) AS n FROM documents",
    "script_fold": "SELECT doc_id, md5(translate(text, 'éñü', 'enu')) AS digest, CASE WHEN regexp_matches(text, '[éñ]') AND regexp_matches(text, '[en]') THEN 'mixed' WHEN regexp_matches(text, '[éñ]') THEN 'traditional' WHEN regexp_matches(text, '[en]') THEN 'simplified' ELSE 'identical' END AS script FROM documents",
    "byte_guard": "SELECT source, sum(n_chars)::BIGINT AS raw, sum(length(text) * 3 + 64)::BIGINT AS stored, sum(length(text) * 3 + 64) <= sum(n_chars) * 10 AS \"within\" FROM documents GROUP BY source",
    "full_cascade": f"SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'parse_error' WHEN doc_id % 31 = 0 THEN 'time:late' WHEN doc_id % 41 = 0 THEN 'read_error' WHEN doc_id % 43 = 0 THEN 'post_reject' WHEN length(text) < 50 THEN 'too_short' WHEN {_LETTERS} < 0.55 THEN 'low_ratio' WHEN {_SYMBOLS} > 0.25 THEN 'symbols' WHEN regexp_matches(text, 'http://|www\\.') THEN 'url' END AS reason FROM documents",
    "dedup_file_exact": f"WITH f AS (SELECT * FROM documents WHERE substr(source, 4)::INT >= 10), o AS (SELECT text, arg_min(doc_id, {_PRIO} * 1000000000 + doc_id) AS owner FROM f GROUP BY text) SELECT doc_id, source, CASE WHEN owner <> doc_id THEN owner END AS dup_of, CASE WHEN owner <> doc_id THEN 'file_exact' END AS reason FROM f JOIN o USING (text)",
    "dedup_doc_priority": f"SELECT doc_id, arg_min(doc_id, {_PRIO} * 1000000000 + doc_id) OVER (PARTITION BY text) AS owner FROM documents",
    "dedup_para_audit": f"WITH {_PARAS.replace('{docs}', 'documents')}, d AS (SELECT DISTINCT doc_id, owner AS dup_of, length(para) AS chars, substr(para, 1, 40) AS preview FROM q WHERE owner <> doc_id) SELECT doc_id, dup_of, count(*) AS n, sum(chars)::BIGINT AS chars FROM d GROUP BY 1, 2",
    "pair_actions": f"WITH {_JUDGED} SELECT * FROM judged",
    "para_near": f"WITH {_JUDGED}, t AS (SELECT loser, winner FROM judged WHERE action = 'paras'), lp AS (SELECT t.loser AS doc_id, t.winner, unnest(list_zip(range(len({_PARA_LIST})), {_PARA_LIST})) AS z FROM t JOIN u ON u.doc_id = t.loser), pw AS (SELECT doc_id, winner, z[1] AS pos, z[2] AS para, {_SIXP.replace('{t}', 'z[2]')} AS ws FROM lp), m AS (SELECT pw.doc_id, pw.winner, pos, len(ws) AS n, len(list_filter(ws, lambda v: list_contains(s.x, v))) AS hits FROM pw JOIN s ON s.doc_id = pw.winner) SELECT doc_id, winner, count(*) AS paras, count(*) FILTER (WHERE n > 0 AND hits >= 0.9 * n) AS dropped, sum(hits)::BIGINT AS hits FROM m GROUP BY 1, 2",
    "final_chars": f"WITH {_UNIQUE}, {_PARAS.replace('{docs}', 'u')}, d AS (SELECT DISTINCT doc_id, owner, length(para) AS chars, substr(para, 1, 40) AS preview FROM q WHERE owner <> doc_id), g AS (SELECT doc_id, sum(chars) AS gone FROM d GROUP BY doc_id) SELECT u.doc_id, greatest(u.n_chars - coalesce(gone, 0), 0)::BIGINT AS chars_final FROM u LEFT JOIN g USING (doc_id)",
    "char_flow": f"WITH {_UNIQUE}, {_PARAS.replace('{docs}', 'u')}, a AS (SELECT source, sum(n_chars) AS clean, sum(CASE WHEN doc_id IN (SELECT doc_id FROM u) THEN 0 ELSE n_chars END) AS l2 FROM documents GROUP BY source), b AS (SELECT source, sum(length(para)) AS l3 FROM q WHERE owner <> doc_id GROUP BY source) SELECT source, clean::BIGINT AS clean, l2::BIGINT AS l2, coalesce(l3, 0)::BIGINT AS l3, (clean - l2 - coalesce(l3, 0))::BIGINT AS final FROM a LEFT JOIN b USING (source)",
    "cross_split": f"WITH d AS (SELECT doc_id, {_SPLIT} AS split, text FROM documents), w AS (SELECT DISTINCT doc_id, split, g FROM (SELECT doc_id, split, unnest({_W}) AS g FROM d) WHERE sha1(g)[16:16] = '0'), t AS (SELECT DISTINCT g FROM w WHERE split = 'train'), h AS (SELECT doc_id, count(*) AS n, count(t.g) AS hits FROM w LEFT JOIN t USING (g) WHERE split <> 'train' GROUP BY doc_id) SELECT d.doc_id, CASE WHEN coalesce(hits >= 0.5 * n, false) THEN 'train' ELSE split END AS split, coalesce(hits >= 0.5 * n, false) AS moved FROM d LEFT JOIN h USING (doc_id)",
    "split_author_disjoint": f"WITH d AS (SELECT doc_id, {_SPLIT} AS split, doc_id % 777 AS x, doc_id % 55 + 1000 AS y FROM documents), t AS (SELECT x AS v FROM d WHERE split = 'train' UNION SELECT y FROM d WHERE split = 'train'), m AS (SELECT doc_id FROM d WHERE split <> 'train' AND (x IN (SELECT v FROM t) OR y IN (SELECT v FROM t))) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM m) THEN 'train' ELSE split END AS split, CASE WHEN doc_id IN (SELECT doc_id FROM m) THEN 'author_seen_in_train' END AS split_note FROM d",
    "id_dedup_null_kept": "SELECT conv_id AS id, conv_id, min(turn) AS turn FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id UNION ALL SELECT NULL, conv_id, turn FROM conversations WHERE conv_id % 3 = 0",
    "range_lookup": f"WITH t AS (SELECT doc_id, {_TOKENS} AS n FROM documents WHERE lang = 'en'), c AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) AS high, sum(n) OVER (ORDER BY doc_id) - n AS low FROM t WHERE n > 0) SELECT draw, doc_id, (draw * 37 - low)::BIGINT AS start FROM range(200) r(draw) JOIN c ON draw * 37 >= low AND draw * 37 < high",
    "pack_sampled": "SELECT r AS row, 256 AS filled, 0 AS others FROM range(200) t(r)",
    "mixture": "WITH t AS (SELECT lang AS category, sum(n_chars) AS tokens, sum(n_chars) * CASE lang WHEN 'en' THEN 2.0 ELSE 1.0 END AS raw FROM documents WHERE lang IN ('en', 'de') GROUP BY lang) SELECT category, tokens::BIGINT AS tokens, round(raw / sum(raw) OVER (), 6) AS p FROM t",
    "asof_backward": "WITH p AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts",
    "overflow_events": "WITH s AS (SELECT user_id, ts, min(event_id) AS step FROM events WHERE event_type <> 'error' GROUP BY 1, 2), l AS (SELECT user_id, arg_max(step, ts) AS last FROM s GROUP BY user_id), a AS (SELECT e.user_id, e.event_id % 5 AS attempt, coalesce(s.step, l.last) AS at_step FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts <= s.ts LEFT JOIN l ON l.user_id = e.user_id) SELECT user_id, at_step, count(*) AS retries, max(attempt) AS worst FROM a GROUP BY 1, 2",
    "recent_windows": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), g AS (SELECT user_id, avg(CASE WHEN r <= 5 THEN value END) AS a, avg(CASE WHEN r > 5 THEN value END) AS b, count(*) FILTER (WHERE r <= 5 AND value > 5) AS spikes, list_sort(list(value) FILTER (WHERE r <= 5)) AS h FROM r WHERE r <= 10 GROUP BY user_id) SELECT user_id, round(a, 6) AS mean_last, round(b, 6) AS mean_before, round(h[len(h) // 2 + 1], 6) AS median, round(CASE WHEN least(len(h) - 1, floor(0.9 * len(h))::INT - 1) < 0 THEN h[len(h)] ELSE h[least(len(h) - 1, floor(0.9 * len(h))::INT - 1) + 1] END, 6) AS p90, spikes FROM g",
    "progress": "WITH g AS (SELECT user_id, min({'ts': ts, 'e': event_id}) AS a, max({'ts': ts, 'e': event_id}) AS b FROM events GROUP BY user_id), r AS (SELECT *, CASE WHEN epoch_us(b.ts) > epoch_us(a.ts) THEN (b.e - a.e) / ((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6) END AS rate FROM g) SELECT user_id, round(rate, 8) AS steps_s, round(b.e / 20000.0::DOUBLE, 6) AS share, round(CASE WHEN rate > 0 THEN greatest(20000 - b.e, 0) / rate / 3600 END, 4) AS hours_left FROM r",
    "schedule_phase": "SELECT step, CASE WHEN step >= 244141 THEN 'final' WHEN step >= 55200 AND step < 56200 THEN 'warmup' WHEN step >= 181161 THEN 'cosine 3/3' WHEN step >= 118181 THEN 'cosine 2/3' WHEN step >= 55200 THEN 'cosine 1/3' END AS phase, (step >= 118181)::INT + (step >= 181161)::INT AS cycle, CASE WHEN step BETWEEN 55200 AND 57200 THEN 55200 WHEN step BETWEEN 118181 AND 120181 THEN 118181 WHEN step BETWEEN 181161 AND 183161 THEN 181161 END AS restart, round(CASE WHEN step < 60000 THEN 3e-4 * (step + 1) / 60000.0::DOUBLE ELSE 3e-5 + 1.35e-4 * (1 + cos(pi() * least(1.0, (step - 60000) / 180000.0::DOUBLE))) END, 12) AS lr FROM range(50000, 250000, 501) t(step)",
    "field_profile_full": "WITH r AS (SELECT 'text' AS field, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents), s AS (SELECT field, count(v) AS present, count(*) FILTER (WHERE v = '') AS empty, count(*) FILTER (WHERE v IS NULL) AS missing, list_sort(list(length(v)) FILTER (WHERE v <> '')) AS l FROM r GROUP BY field) SELECT field, present, empty, missing, len(l) AS n, list_sum(l)::BIGINT AS total, list_min(l) AS least, list_max(l) AS most, l[floor(0.5 * (len(l) - 1))::INT + 1] AS p50, l[floor(0.9 * (len(l) - 1))::INT + 1] AS p90, l[floor(0.99 * (len(l) - 1))::INT + 1] AS p99, round(list_sum(l) / len(l)::DOUBLE, 4) AS mean FROM s",
    "schema_keys": "SELECT event_type AS file, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2",
    "char_sets": "SELECT ch, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY ch",
    "char_set_difference": "SELECT ch, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) WHERE ch NOT IN (SELECT unnest(regexp_extract_all(text, '(?s).')) FROM benchmark) GROUP BY ch ORDER BY n DESC, ch LIMIT 200",
    "overlap_by_source": f"WITH k AS (SELECT doc_id, source, md5(g) AS h FROM (SELECT doc_id, source, unnest({_W}) AS g FROM documents)), f AS (SELECT * FROM k WHERE ('0x' || h[13:16])::INT % 2 = 0), b AS (SELECT DISTINCT md5(g) AS h FROM (SELECT unnest({_W}) AS g FROM benchmark)), p AS (SELECT source, doc_id, count(*) AS n, count(b.h) AS m FROM f LEFT JOIN b USING (h) GROUP BY 1, 2 HAVING count(b.h) > 0) SELECT source, count(*) AS docs, sum(n)::BIGINT AS windows, sum(m)::BIGINT AS matched, round(sum(m) / sum(n)::DOUBLE, 6) AS ratio FROM p GROUP BY source",
    "duplicate_examples": "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 2) SELECT n, count(*) AS ids, array_to_string(list_sort(list(conv_id))[1:20], ',') AS examples FROM c GROUP BY n",
    "greedy_tokens": "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS l, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings), s AS (SELECT vec_id, token, CASE WHEN token < 16 THEN CASE WHEN l < 0 THEN l * 2 ELSE l / 2 END ELSE l END AS l FROM v WHERE token <> 17) SELECT vec_id, token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, token) AS rn FROM s) WHERE rn = 1",
    "choose_tokens": "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS l, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings), s AS (SELECT vec_id, token, CASE WHEN token < 8 THEN CASE WHEN l < 0 THEN l * 1.3 ELSE l / 1.3 END ELSE l END AS l FROM v WHERE token NOT IN (3, 5)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, token) AS rn FROM s), e AS (SELECT *, exp((l - max(l) OVER (PARTITION BY vec_id)) / 0.7) AS e FROM r WHERE rn <= 20), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e), b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT vec_id, token, round(e / sum(e) OVER (PARTITION BY vec_id), 5) AS p FROM b WHERE before < 0.5",
    "vector_mean": "WITH v AS (SELECT label, vec_id % 3 + 1 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos, round(sum(x * w) / sum(w), 6) AS m FROM v GROUP BY 1, 2",
    "settings_drift": "WITH a AS (SELECT doc_id AS key, quality AS saved FROM labels), b AS (SELECT doc_id AS key, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS now FROM labels WHERE doc_id % 5 <> 0) SELECT coalesce(a.key, b.key) AS key, saved, now FROM a FULL JOIN b ON a.key = b.key WHERE saved IS DISTINCT FROM now",
    "integrity_checks": "WITH e AS (SELECT vec_id, 'layers.' || vec_id || CASE WHEN vec_id % 4 = 0 THEN '_sq' ELSE '' END AS name, list_min(embedding) AS least FROM embeddings) SELECT name, CASE WHEN vec_id % 9 = 0 THEN 'missing' WHEN vec_id % 10 = 0 THEN 'unexpected' WHEN vec_id % 11 = 0 THEN 'shape' ELSE 'negative' END AS problem FROM e WHERE (vec_id % 9 = 0 AND vec_id % 10 <> 0) OR (vec_id % 9 <> 0 AND (vec_id % 10 = 0 OR vec_id % 11 = 0 OR (vec_id % 4 = 0 AND least < 0)))",
    "retained_names": "WITH e AS (SELECT user_id::VARCHAR AS run, event_id % 5 <> 0 AS done, CASE WHEN event_id % 5 = 0 THEN 'step_tmp' || event_id ELSE 'step_' || lpad(event_id::VARCHAR, 8, '0') END AS name FROM events) SELECT run, name, CASE WHEN done THEN row_number() OVER (PARTITION BY run, done ORDER BY name DESC) <= 3 END AS keep FROM e",
    "aligned_zip": "SELECT doc_id, lang, n_chars FROM documents",
    "book_match": "SELECT DISTINCT b.book, p.title FROM (SELECT DISTINCT trim(string_split(text, ' ')[1]) AS book FROM benchmark) b JOIN (SELECT DISTINCT trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages) p ON length(book) >= 2 AND length(title) >= 2 AND (contains(title, book) OR contains(book, title))",
    "stream_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "stream_rollback": "SELECT DISTINCT event_type AS run FROM events",
    "stream_join": "SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'error' AND b.event_type = 'purchase'",
    "stream_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k",
}


def queries():
    return {n: _shared(n) for n in SHARED} | dict(_PLANS)


def oracle_sql():
    return dict(SHARED) | dict(_ORACLES)

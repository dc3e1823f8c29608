"""Profiling, evaluation and integrity operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def field_profile(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: present, empty, values, total, least and most characters, mean, and the lower quantiles (the element at floor(q (n - 1)))."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    long_ = rows.select(pairs.alias("p")).select("p.field", "p.value")
    seen = long_.groupBy("field").agg(F.count("value").alias("present"), F.count_if(F.col("value") == "").alias("empty"), F.count_if(F.col("value").isNull()).alias("missing"))
    # Quantiles of lengths from (length, count) rows, so no field's values meet in one list.
    counts = long_.where("value <> ''").groupBy("field", F.length("value").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("field")
    c = counts.withColumn("upto", F.sum("c").over(w.orderBy("len"))).withColumn("n", F.sum("c").over(w))
    q = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col("len")))
    stats = c.groupBy("field").agg(F.max("n").alias("n"), F.sum(F.col("len") * F.col("c")).alias("total"), F.min("len").alias("least"), F.max("len").alias("most"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"))
    return seen.join(stats, "field", "left").withColumn("mean", F.round(F.col("total") / F.col("n"), 4))


def schema_keys(lines: DataFrame, sample: int = 5000) -> DataFrame:
    """(file, key, type, n) of the first ``sample`` JSON lines (file, line_no, value) of each file."""
    first = lines.where(F.col("line_no") <= sample).select("file", F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"), F.col("value"))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), F.concat(F.lit("$['"), F.col("key"), F.lit("']")), "variant"))
    return first.groupBy("file", "key", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def char_counts(docs: DataFrame) -> DataFrame:
    """(ch, n, docs): how often each character occurs, and in how many documents; counted per document first."""
    per = docs.select(F.explode(F.split(F.col("text"), "")).alias("ch"), "doc_id").where("ch <> ''").groupBy("doc_id", "ch").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("ch").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


def overlap_by_source(docs: DataFrame, other: DataFrame, size: int = 24, step: int = 8, share: int = 64) -> DataFrame:
    """Per source, of documents with a match: windows sampled (one in ``share``), windows that ``other`` has, and their ratio."""
    keep = lambda c: F.pmod(F.conv(F.substring(c, 13, 4), 16, 10).cast("int"), F.lit(share)) == 0
    mine = docs.select("doc_id", "source", F.explode(F.array_distinct(T.windows(F.col("text"), size, step))).alias("w")).withColumn("h", F.md5("w")).where(keep(F.col("h")))
    theirs = other.select(F.explode(F.array_distinct(T.windows(F.col("text"), size, step))).alias("w")).select(F.md5("w").alias("h")).where(keep(F.col("h"))).distinct().withColumn("hit", F.lit(1))
    per = mine.join(theirs, "h", "left").groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("m")).where("m > 0")
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("windows"), F.sum("m").alias("matched")).withColumn("ratio", F.round(F.col("matched") / F.col("windows"), 6))


def manifest(files: DataFrame) -> DataFrame:
    """(path, size, lines, chars) of text files: a last line without a line feed counts."""
    t = F.decode("content", "UTF-8")
    ends = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return files.select("path", F.col("length").alias("size"), (ends + F.when((F.length(t) > 0) & ~t.endswith("\n"), 1).otherwise(0)).cast("long").alias("lines"), F.length(t).cast("long").alias("chars"))


def next_tokens(logits: DataFrame, key: str, top_k: int = 0, top_p: float = 1.0, temperature: float = 1.0, penalty: float = 1.0, history: DataFrame | None = None, blocked: list[int] = []) -> DataFrame:
    """(key, token, p) a sampler may choose from (token, logit) rows: penalty for tokens of ``history``, blocked ones out, then top-k, then top-p; with temperature 0 the best one.

    Ties are broken by the smaller token.
    """
    if temperature < 0 or not 0 < top_p <= 1 or top_k < 0 or penalty < 1:
        raise ValueError("temperature, top_p, top_k or penalty out of range")
    rows = logits.where(~F.col("token").isin(blocked)) if blocked else logits
    score = F.col("logit").cast("double")
    if history is not None and penalty > 1:
        rows = rows.join(history.select(key, "token").distinct().withColumn("_seen", F.lit(True)), [key, "token"], "left")
        score = F.when(F.col("_seen"), F.when(score < 0, score * penalty).otherwise(score / penalty)).otherwise(score)
    w = Window.partitionBy(key)
    ranked = rows.select(key, "token", score.alias("s")).withColumn("rn", F.row_number().over(w.orderBy(F.desc("s"), "token")))
    if temperature == 0:
        return ranked.where("rn = 1").select(key, "token", F.lit(1.0).alias("p"))
    if top_k:
        ranked = ranked.where(F.col("rn") <= top_k)
    soft = ranked.withColumn("e", F.exp((F.col("s") - F.max("s").over(w)) / temperature)).withColumn("p", F.col("e") / F.sum("e").over(w))
    before = F.coalesce(F.sum("p").over(w.orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = soft.withColumn("_b", before).where(F.col("_b") < top_p)
    return kept.select(key, "token", (F.col("e") / F.sum("e").over(w)).alias("p"))


def distinct_ratio(t: Column, n: int = 4) -> Column:
    """Share of distinct runs of ``n`` characters, three digits; null for n characters or fewer (and for null)."""
    grams = F.concat(*[F.regexp_extract_all(F.substr(t, F.lit(1 + k)), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for k in range(n)])
    return F.when(F.length(t) > n, F.round(F.size(F.array_distinct(grams)) / (F.length(t) - n + 1), 3))


def output_checks(out: DataFrame, blocked: list[int]) -> DataFrame:
    """Adds ``flags`` and ``notes`` to generations (text, prompt, ids, stop)."""
    mark = "�"
    span = F.when((F.col("prompt") != "") & F.col("text").startswith(F.col("prompt")), F.substr("text", F.length("prompt") + 1)).otherwise(F.col("text"))
    core = F.regexp_replace("_span", f"{mark}+$", "")
    inside, cut = F.contains("_core", F.lit(mark)), F.col("_span") != F.col("_core")
    flags = F.array(F.when(F.size("ids") == 0, "zero-tokens"), F.when(F.arrays_overlap("ids", F.array(*[F.lit(b) for b in blocked]).cast("array<int>")), "blocked-special-leaked"), F.when(inside | (cut & (F.col("stop") != "length")), "replacement-char"))
    low = F.when((F.length("_span") >= 40) & (distinct_ratio(F.col("_span")) < 0.7), F.concat(F.lit("low-distinctness="), F.format_number(distinct_ratio(F.col("_span")), 2)))
    notes = F.array(F.when(~inside & cut & (F.col("stop") == "length"), "trailing-partial-char"), F.when((F.col("stop") == "eod") & (T.strip(F.col("_span")) == ""), "immediate-eod"), low)
    return out.withColumn("_span", span).withColumn("_core", core).withColumn("flags", F.array_compact(flags)).withColumn("notes", F.array_compact(notes)).drop("_span", "_core")


def pair_sketch(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Adds the additive parts of two vectors' similarity: dot, ll, rr, dd (squared difference) and the largest difference."""
    zip_ = lambda f: F.zip_with(left, right, f)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    d = lambda x, y: x.cast("double") - y.cast("double")
    return rows.select("*", total(zip_(lambda x, y: x.cast("double") * y)).alias("dot"), total(zip_(lambda x, y: x.cast("double") * x)).alias("ll"), total(zip_(lambda x, y: y.cast("double") * y)).alias("rr"),
                       total(zip_(lambda x, y: d(x, y) * d(x, y))).alias("dd"), F.array_max(zip_(lambda x, y: F.abs(d(x, y)))).alias("max_abs"))


def similarity(sketched: DataFrame, levels: list[str], name: str) -> DataFrame:
    """Cosine, relative L2, norm of the difference, largest difference and the worst member for each level of a rollup."""
    g = sketched.rollup(*levels).agg(*[F.sum(c).alias(c) for c in ("dot", "ll", "rr", "dd")], F.max("max_abs").alias("max_abs"), F.max_by(name, F.struct("dd", name)).alias("worst"), F.count(F.lit(1)).alias("n"))
    return g.select(*levels, "n", "worst", "max_abs", F.when((F.col("ll") > 0) & (F.col("rr") > 0), F.col("dot") / F.sqrt(F.col("ll") * F.col("rr"))).alias("cosine"), F.when(F.col("rr") > 0, F.sqrt(F.col("dd") / F.col("rr"))).alias("relative_l2"), F.sqrt("dd").alias("diff_norm"))


def vector_mean(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """Element-wise mean of vectors weighted by a count."""
    per = rows.select(*keys, F.posexplode(vector).alias("pos", "v"), F.col(weight).alias("w"))
    means = per.groupBy(*keys, "pos").agg((F.sum(F.col("v").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A join that raises an error where a key is missing on either side."""
    j = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full")
    return j.where(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("missing on one side: "), F.col(key).cast("string"))).cast("boolean"))).drop("_l", "_r")


def drift(saved: DataFrame, now: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, saved, now) of settings that differ, null-safe; one side's keys alone count as differing."""
    j = saved.select(key, F.col(value).alias("saved")).join(now.select(key, F.col(value).alias("now")), key, "full")
    return j.where(~F.col("saved").eqNullSafe(F.col("now")))


def integrity(saved: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, problem) of tensors (name, values) against (name, size): missing, unexpected, shape, not_finite or negative (names ending in ``_sq``)."""
    j = saved.select("name", "values").join(wanted.select("name", "size"), "name", "full")
    bad = lambda f: F.exists("values", f)
    problem = (F.when(F.col("values").isNull(), "missing").when(F.col("size").isNull(), "unexpected").when(F.size("values") != F.col("size"), "shape")
               .when(bad(lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "not_finite").when(F.col("name").endswith("_sq") & bad(lambda v: v < 0), "negative"))
    return j.select("name", problem.alias("problem")).where("problem is not null")


def tensor_group(name: Column) -> Column:
    """The part of the model that a weight's name belongs to; patterns are fixed values."""
    proj = F.regexp_extract(name, r"\.(q_proj|k_proj|v_proj|o_proj)\.", 1)
    mlp = F.regexp_extract(name, r"\.mlp\.(gate_proj|up_proj|down_proj)\.", 1)
    return (F.when(name == "embed_tokens.weight", "tied_embedding").when(name.startswith("norm."), "final_norm").when(name.rlike(r"\.(input_norm|post_attention_norm)\."), "layer_norms")
            .when(name.contains(".attention.") & (proj != ""), F.concat(F.lit("attention_"), proj)).when(mlp != "", F.concat(F.lit("mlp_"), mlp)).otherwise("other"))


def retained(names: DataFrame, keep: int, key: str = "run", name: str = "name") -> DataFrame:
    """Adds ``keep``: among complete checkpoints (``step_`` and digits) the newest ``keep`` of a run stay; other names are never touched (null)."""
    done = F.col(name).rlike(r"^step_\d+$")
    w = Window.partitionBy(key, done).orderBy(F.desc(name))
    return names.withColumn("keep", F.when(done, F.row_number().over(w) <= keep))


def latest_checkpoint(names: DataFrame, key: str = "run", name: str = "name") -> DataFrame:
    """The greatest complete name of each run; a run without one raises an error."""
    g = names.groupBy(key).agg(F.max(F.when(F.col(name).rlike(r"^step_\d+$"), F.col(name))).alias("latest"))
    return g.select(key, F.when(F.col("latest").isNotNull(), F.col("latest")).otherwise(F.raise_error(F.concat(F.lit("no checkpoint in "), F.col(key)))).cast("string").alias("latest"))


def book_match(books: DataFrame, titles: DataFrame) -> DataFrame:
    """(book, title) where one holds the other, both of two characters or more; titles are deduplicated and must be a small side."""
    from ..stage import BROADCAST_BYTES

    small = titles.select(F.trim("title").alias("title")).where(F.length("title") >= 2).distinct()
    size = small.select(F.coalesce(F.sum(F.octet_length("title") + 16), F.lit(0)).alias("b")).first().b
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of titles to compare with every book; split them")
    b = books.select(F.trim("book").alias("book")).where(F.length("book") >= 2).distinct()
    return b.join(F.broadcast(small), F.contains("title", F.col("book")) | F.contains("book", F.col("title")))

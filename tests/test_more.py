"""Small fixtures for the operators that the test tables exercise little."""

import json
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella import stage
from tessella.functions import text as X
from tessella.operators import cleaning, dedup, evaluate, logs, packing
from tessella.sources import formats, readers
from tessella.streaming import tail


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def one(spark, **cols):
    """A frame of one row."""
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()])


# ---- sources and sinks ----

def test_jsonl_missing_blank_and_bad(spark, tmp_path):
    schema = T.StructType.fromDDL("id long, text string")
    assert readers.jsonl(spark, str(tmp_path / "none"), schema).collect() == []
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "x"}\n\n{bad ' + "y" * 300 + "\n")
    got = readers.jsonl(spark, str(tmp_path / "a.jsonl"), schema).orderBy(F.col("id").asc_nulls_last()).collect()
    assert [(r.id, r.text) for r in got] == [(1, "x"), (None, None)] and got[0].json_error is None and len(got[1].json_error) == 200


def test_json_array_and_corpus_texts(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"title": "t", "paragraphs": ["a", "b"]}, {"title": "u"}]))
    assert values(readers.json_array(spark, str(tmp_path / "p.json"), T.StructType.fromDDL("title string, paragraphs array<string>")), "title") == [("t",), ("u",)]
    lines = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert values(formats.corpus_texts(lines('{"content": "a", "text": "b"}', " ", '{"text": "c"}')), "text") == [("a",), ("c",)]
    for bad in ('{"id": 3}', "{oops"):
        with pytest.raises(Exception):
            formats.corpus_texts(lines(bad)).collect()
    many = spark.createDataFrame([("r", 1, '{"tok_s": 1}'), ("r", 2, "text"), ("r", 3, '{"tok_s": 2}')], "run string, line_no int, value string")
    assert values(formats.last_json(many, "run", "tok_s double"), "run", "tok_s") == [("r", 2.0)]


def test_binary_layouts_refuse_bad_files(spark, tmp_path):
    body = formats.index_bytes([(3, 123456789, 4096, 6)], [0.1] * 6)
    assert struct.calcsize(formats.INDEX_HEADER) == 88 and struct.calcsize(formats.INDEX_RECORD) == 20 and len(body) == 108
    frame = lambda data: spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    assert values(formats.index_rows(frame(body)), "shard", "offset", "length", "category") == [(3, 123456789, 4096, 6)]
    assert values(formats.records(frame(struct.pack("<4H", 1, 2, 3, 4)), 2), "record", "ids") == [(0, [1, 2]), (1, [3, 4])]
    for df in (formats.index_rows(frame(body[:-1])), formats.index_rows(frame(b"x" * 108)), formats.records(frame(b"abc"), 2), formats.records(frame(struct.pack("<2H", 1, 40000)), 2), formats.from_npy(frame(b"no numpy"))):
        with pytest.raises(Exception):
            df.collect()


def test_text_tree_identity_and_upsert(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, t in (("d/a.txt", "one\ntwo"), ("d/._a.txt", "no"), ("b.md", "no")):
        (tmp_path / name).write_text(t)
    assert values(readers.text_tree(spark, str(tmp_path), "s"), "doc_id", "text") == [("s|a.txt", "one\ntwo")]
    files = formats.read_files(spark, str(tmp_path / "d"), "a.txt")
    first = stage.materialize(formats.identity(files))
    assert formats.same_identity(formats.identity(files), first)
    (tmp_path / "d/a.txt").write_text("longer now")
    assert not formats.same_identity(formats.identity(formats.read_files(spark, str(tmp_path / "d"), "a.txt")), first)
    logs_dir, out = tmp_path / "logs", str(tmp_path / "out")
    logs_dir.mkdir()
    for k, step in ((0, 5), (1, 9)):
        (logs_dir / f"r.{k}.log").write_text(f"step={step}\n")
        stream = tail.log_tail(spark, str(logs_dir)).select("run", F.regexp_extract("value", r"step=(\d+)", 1).cast("long").alias("step"))
        tail.upsert_history(stream, out, ["run"], "step")
        assert values(tail.history(spark, out), "run", "step") == [("r", step)]


def test_book_fields(spark):
    html = ('<h1 class="t">A Book by Someone</h1><a itemprop="creator" href="x">Someone, 1800-1870</a><a itemprop="creator">Old One, 60 BCE-5 BCE</a>'
            '<table><tr><th>Original Publication</th><td>China, 1880</td></tr><tr><th>Release Date</th> <td>Jan 1, 2001</td></tr><tr><th>Language</th><td><i>Chinese</i></td></tr></table>')
    r = readers.book_fields(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (r.title, r.by, r.death_years, r.original_publication, r.release_date, r.languages) == ("A Book", "Someone", [1870, -5], "China, 1880", "Jan 1, 2001", ["Chinese"])


# ---- cleaning ----

def test_cleaners(spark):
    t = F.col("t")
    frame = lambda s: spark.createDataFrame([(s,)], "t string")
    clean, status, reason = cleaning.text_gate(t, "MODERN")
    run = lambda s: tuple(frame(s).select(clean, status, reason).first())
    assert run("-{a}- <b>x</b> 1930年") == ("a x 1930年", "pass", "year_evidence")
    assert run("1950年 MODERN")[1:] == ("reject", "modern") and run("民國40年")[1:] == ("reject", "late_year") and run("x")[1:] == ("pass", "no_year")
    assert frame("民國5年 1899年 1899").select(cleaning.years(t)).first()[0] == [1899, 1916]
    poem = json.dumps([{"title": "T", "author": "A", "paragraphs": ["x", "y"]}, {"strains": ["z"]}])
    assert frame(poem).select(cleaning.flatten_poems(t)).first()[0] == "《T》 A\nx\ny\n\nz"
    assert frame("not json").select(cleaning.flatten_poems(t)).first()[0] == "not json"
    assert frame("a|b/c").select(cleaning.safe_name(t)).first()[0] == "a_b__c"
    assert frame("，a。 b!").select(cleaning.strip_punctuation(t)).first()[0] == "ab"
    assert frame("　x ").select(X.strip(t)).first()[0] == "x"
    assert frame("后來").select(cleaning.script_class(t, {"來": "来", "後": "后"})).first()[0] == "mixed"
    gates = [one(spark, s=cleaning.publication_gate(F.lit(p), F.lit(d).cast("array<int>") if d is None else F.array(*map(F.lit, d)))).first().s for p, d in (("in 1880", None), ("in 1980", [1900]), (None, [1960]), (None, None))]
    assert gates == ["pass", "pass", "quarantine", "quarantine"]
    over = spark.createDataFrame([("s", "x" * 50, 10)], "source string, text string, chars_raw long")
    assert not cleaning.byte_guard(over).first().within
    with pytest.raises(Exception):
        cleaning.guarded(over).collect()


def test_cascade_order(spark):
    text = "good words " * 10
    rows = [("error", "reject", "io", text, "parse_error"), ("ok", "reject", "io", text, "time:late"), ("ok", "pass", "io", text, "read_error"), ("ok", "pass", None, "x" * 49, "too_short"), ("ok", "pass", None, "x" * 50, None),
            ("ok", "pass", None, "1" * 80, "low_ratio"), ("ok", "pass", None, text + "www.x", "url"), ("ok", "pass", None, None, "too_short")]
    df = spark.createDataFrame([(i, *r[:4], "late", None) for i, r in enumerate(rows)], "i int, parse_status string, time_status string, read_error string, text string, time_reason string, post_status string")
    assert values(cleaning.gate(df).orderBy("i"), "reason") == [(r[4],) for r in rows]


# ---- dedup levels ----

def test_levels_with_priority(spark):
    order = ["high", "low"]
    docs = spark.createDataFrame([(1, "low", "same\nown\nown"), (2, "high", "same\nother"), (3, "low", "other"), (4, "low", None)], "doc_id long, source string, text string").withColumn("n_chars", F.length("text"))
    paras = dedup.paragraph_exact(docs, order)
    assert sorted(values(paras.where("owner <> doc_id"), "doc_id", "para", "owner")) == [(1, "same", 2), (3, "other", 2)]
    assert sorted(values(dedup.final_chars(docs, dedup.audit(paras)), "doc_id", "chars_final"))[:3] == [(1, 8), (2, 10), (3, 0)]
    files = spark.createDataFrame([(1, "low", bytearray(b"a")), (2, "high", bytearray(b"a")), (3, "low", None), (4, "else", bytearray(b"a"))], "doc_id long, source string, content binary")
    assert sorted(values(dedup.file_exact(files, order, order), "doc_id", "dup_of", "reason")) == [(1, 2, "file_exact"), (2, None, None), (3, None, "read_error")]
    assert dict(values(dedup.document_exact(docs.unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(5).cast("long"))), order), "doc_id", "owner"))[5] == 4


def test_pairs_thresholds_and_greedy(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "b")], "doc_id long, source string")
    scored = spark.createDataFrame([(1, 2, 9, 0.985), (1, 3, 8, 0.80), (2, 3, 7, 0.799), (1, 4, 6, 0.99), (3, 5, 5, 0.29), (4, 3, 4, 0.95)], "a long, b long, c long, similarity double")
    judged = dedup.judge_pairs(scored, docs, ["a", "b"])
    assert sorted(values(judged, "loser", "winner", "action")) == [(1, 2, "paras"), (1, 4, "drop"), (3, 1, "drop"), (3, 2, "paras"), (3, 4, "drop")]
    # 3 goes first; its other pair no longer counts.
    assert sorted(values(dedup.greedy_drops(judged), "loser", "winner")) == [(1, 4), (3, 1)]


def test_near_paragraphs_and_split_moves(spark):
    long_ = "abcdefghijklmnopqrstuvwxyz0123456789" * 2
    docs = spark.createDataFrame([(1, "a", long_ + "\nshort"), (2, "b", long_ + "\nshort\n" + "Z9y8X7w6" * 6)], "doc_id long, source string, text string")
    judged = spark.createDataFrame([(2, 1, "paras")], "loser long, winner long, action string")
    assert sorted(values(dedup.near_paragraphs(judged, docs), "pos", "dropped")) == [(0, True), (1, False), (2, False)]
    split = docs.withColumn("split", F.when(F.col("doc_id") == 1, "train").otherwise("val"))
    moved = dedup.cross_split(split, 0.3, "0123456789abcdef")
    assert sorted(values(moved, "doc_id", "split", "moved")) == [(1, "train", False), (2, "train", True)]
    people = spark.createDataFrame([(1, "train", "甲"), (2, "val", "乙、 甲"), (3, "test", "丙"), (4, "val", None)], "doc_id long, split string, author string")
    assert sorted(values(dedup.author_disjoint(people), "doc_id", "split", "split_note"), key=str) == [(1, "train", None), (2, "train", "author_seen_in_train"), (3, "test", None), (4, "val", None)]


# ---- tokens ----

def test_sequential_frame_equals_the_list_form(spark):
    docs = [[10, 11], [20, 21, 22], [], [30], list(range(40, 61)), [70, 71, 72]]
    frame = spark.createDataFrame([("g", i, d) for i, d in enumerate(docs)], "k string, doc_id long, tokens array<int>")
    for length in (3, 4, 7, 40):
        got = values(packing.pack_sequential(frame, ["k"], length).orderBy("row"), "ids")
        assert [r[0] for r in got] == packing.sequential_rows([d for d in docs if d], length, 2, len(got))


def test_sampled_rows_resume_and_shards(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 9) for i in range(60)], "doc_id long, category string, length long")
    whole = {(r.row, r.k): (r.doc_id, r.start, r.take, r.eod) for r in packing.pack_sampled(docs, {"a": 0.9, "b": 0.1, "c": 1.0}, 6, 31, 7).collect()}
    rest = {(r.row, r.k): (r.doc_id, r.start, r.take, r.eod) for r in packing.pack_sampled(docs, {"a": 0.9, "b": 0.1}, 3, 31, 7, 3, draws=2).collect()}
    assert rest == {k: v for k, v in whole.items() if k[0] >= 3}
    for row in range(6):
        parts = [whole[k] for k in sorted(whole) if k[0] == row]
        assert sum(t + e for _, _, t, e in parts) == 32 and all(s + t <= 1 + d % 9 for d, s, t, _ in parts)
    with pytest.raises(ValueError):
        packing.pack_sampled(docs.where("false"), {"a": 1.0}, 1, 3, 1)
    lengths = [5, 0, 6, 20, 1, 9, 3, 10]
    sh = packing.shard_offsets(spark.createDataFrame([("s", i, n) for i, n in enumerate(lengths)], "source string, doc_id long, tokens long"), 10)
    assert sorted(values(sh, "doc_id", "shard", "offset")) == [(0, 0, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 3, 1), (6, 4, 0), (7, 5, 0)]
    assert all(r.gaps == r.overlaps == r.overruns == 0 and r.follows for r in packing.validate_shards(sh, 10).collect())


# ---- logs ----

def test_alert_rules(spark):
    base = dict(last_s=1000, now_s=1100, completed=False, fatal_lines=[], overflows=0, worst_attempt=0, scale_drops=0, grad_median=1.0, grad_spikes=0, val_rise=0.0, restart=None, save_interval=0, checkpoint_s=None, sec_per_step=1.0, eta_own=None, eta_said=None, free_gib=100.0)
    edges = [55200, 118181, 181161, 244141]
    cases = [({}, []), ({"now_s": 1901}, ["alert:stale"]), ({"now_s": 1901, "completed": True}, []), ({"now_s": 1301}, ["warn:stale"]), ({"now_s": 1300}, []), ({"fatal_lines": ["x"]}, ["alert:fatal"]),
             ({"overflows": 3, "worst_attempt": 1, "scale_drops": 3}, ["alert:overflow"]), ({"overflows": 1, "worst_attempt": 4}, ["alert:overflow"]), ({"overflows": 2, "worst_attempt": 1}, ["warn:overflow"]), ({"overflows": 1, "worst_attempt": 1}, ["info:overflow"]),
             ({"scale_drops": 1}, ["warn:scale"]), ({"grad_median": 2.6, "grad_spikes": 5}, ["warn:grad_median"]), ({"grad_spikes": 3}, ["warn:grad_spikes"]), ({"save_interval": 10, "checkpoint_s": 1000, "now_s": 1026}, ["warn:checkpoint"]),
             ({"eta_own": 12.0, "eta_said": 10.0}, ["warn:eta"]), ({"free_gib": 14.9}, ["warn:disk"]), ({"last_s": None}, ["alert:no_log"])]
    for step, rise, want in ((118200, 0.10, ["info:val_rise"]), (150000, 0.10, ["warn:val_rise"]), (150000, 0.04, []), (244141, 0.10, ["warn:val_rise"])):
        at = one(spark, r=logs.after_boundary(F.lit(step), edges, 2000)).first().r
        cases.append(({"val_rise": rise, "restart": at}, want))
    schema = "i int, last_s long, now_s long, completed boolean, fatal_lines array<string>, overflows int, worst_attempt int, scale_drops int, grad_median double, grad_spikes int, val_rise double, restart int, save_interval int, checkpoint_s long, sec_per_step double, eta_own double, eta_said double, free_gib double"
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], schema)
    got = logs.alerts(df).orderBy("i").collect()
    assert [r.alerts for r in got] == [w for _, w in cases] and [r.ok for r in got] == [not any(x.startswith("alert") for x in w) for _, w in cases]


def test_boundaries_and_as_of(spark):
    edges = [55200, 118181, 181161, 244141]
    hits = {s: one(spark, r=logs.after_boundary(F.lit(s), edges, 2000)).first().r for s in (118181, 120181, 118180, 120182, 150000, 244141)}
    assert hits == {118181: 118181, 120181: 118181, 118180: None, 120182: None, 150000: None, 244141: None}
    left = spark.createDataFrame([("k", 1, 5), ("k", 2, 9), ("k", 3, 30), ("z", 4, 1)], "key string, id long, ts long")
    right = spark.createDataFrame([("k", 9, 70), ("k", 9, 60), ("k", 12, 80)], "key string, ts long, v long")
    run = lambda f, **kw: dict(values(f(left, right, "key", "ts", "v", "out", **kw), "id", "out"))
    assert run(logs.asof_forward) == {1: 60, 2: 60, 3: None, 4: None}
    assert run(logs.asof_forward, else_last=True) == {1: 60, 2: 60, 3: 80, 4: None}
    assert run(logs.asof_backward) == {1: None, 2: 70, 3: 80, 4: None}
    ten = F.array(*[F.lit(float(x)) for x in range(10, 0, -1)])
    r = one(spark, m=logs.upper_median(ten), p=logs.high_quantile(ten), q=logs.high_quantile(F.array(F.lit(4.0)))).first()
    assert (r.m, r.p, r.q) == (6.0, 9.0, 4.0)


def test_stream_rollback_and_states(spark, tmp_path):
    rows = [("r", s, 1.0) for s in (100, 101, 102, 101)]
    spark.createDataFrame(rows, "run string, step long, loss double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, step long, loss double").parquet(str(tmp_path / "in"))
    assert values(tail.run_once(tail.rollback_stream(stream), "t", "update"), "n", "last_step") == [(2, 101)]
    lines = spark.createDataFrame([("a", "2026-01-01 00:00:00", "tokens=1 tok/s=2"), ("b", "2026-01-01 00:00:00", "target reached"), ("c", "2026-01-01 00:00:00", "Traceback (most recent call last)")], "run string, ts string, value string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.run: (r.state, r.shown, r.level) for r in tail.stale(tail.run_states(lines), "timestamp'2026-01-01 00:05:01'").collect()}
    assert got == {"a": ("live", "paused", "warn"), "b": ("finished", "finished", "ok"), "c": ("error", "error", "warn")}


# ---- evaluation and integrity ----

def test_selection(spark):
    v = spark.createDataFrame([(0, t, l) for t, l in enumerate([1.0, 3.0, 2.0])], "k int, token int, logit double")
    seen = spark.createDataFrame([(0, 1)], "k int, token int")
    assert values(evaluate.next_tokens(v, "k", temperature=0, penalty=2.0, history=seen, blocked=[0]), "token") == [(2,)]
    w = spark.createDataFrame([(0, t, l) for t, l in enumerate([0.0, 1.0, 4.0, 2.0])], "k int, token int, logit double")
    assert values(evaluate.next_tokens(w, "k", top_k=1), "token", "p") == [(2, 1.0)]
    with pytest.raises(ValueError):
        evaluate.next_tokens(w, "k", top_p=0)


def test_output_checks(spark):
    rows = [("p text", "p", [1], "eod"), ("", "", [], "length"), ("a�b", "", [0], "length"), ("ab�", "", [1], "length"), ("ab�", "", [1], "eod"), (" ", "", [1], "eod"), ("ab" * 30, "", [1], "length")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, prompt string, ids array<int>, stop string")
    got = [(r.flags, [n.split("=")[0] for n in r.notes]) for r in evaluate.output_checks(df, [0]).orderBy("i").collect()]
    assert got == [([], []), (["zero-tokens"], []), (["blocked-special-leaked", "replacement-char"], []), ([], ["trailing-partial-char"]), (["replacement-char"], []), ([], ["immediate-eod"]), ([], ["low-distinctness"])]


def test_similarity_and_vectors(spark):
    df = spark.createDataFrame([("a", "x", [1.0, 0.0], [1.0, 0.0]), ("a", "y", [0.0, 2.0], [0.0, 1.0]), ("b", "z", [1.0, 1.0], [-1.0, -1.0])], "g string, name string, l array<double>, r array<double>")
    got = {r.g: r for r in evaluate.similarity(evaluate.pair_sketch(df, "l", "r"), ["g"], "name").collect()}
    assert got["a"].cosine == pytest.approx(3 / 10 ** 0.5) and got["a"].worst == "y" and got["a"].max_abs == 1 and got["b"].cosine == pytest.approx(-1) and got[None].diff_norm == pytest.approx(3) and got["a"].relative_l2 == pytest.approx(0.5 ** 0.5)
    means = spark.createDataFrame([("k", [1.0, 2.0], 1), ("k", [4.0, 8.0], 2)], "k string, v array<double>, n int")
    assert values(evaluate.vector_mean(means, ["k"], "v", "n"), "mean") == [([3.0, 6.0],)]


def test_names_alignment_and_retention(spark):
    names = spark.createDataFrame([("r", n) for n in ("step_00000200", "step_00000400", "step_00000600", "step_00000800", "step_x", "tmp")], "run string, name string")
    assert dict(values(evaluate.retained(names, 3), "name", "keep")) == {"step_00000200": False, "step_00000400": True, "step_00000600": True, "step_00000800": True, "step_x": None, "tmp": None}
    assert values(evaluate.latest_checkpoint(names), "latest") == [("step_00000800",)]
    with pytest.raises(Exception):
        evaluate.latest_checkpoint(names.where("name = 'tmp'")).collect()
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(4).withColumn("y", F.lit(2))
    assert evaluate.aligned(a, b.where("id < 3"), "id").count() == 3
    with pytest.raises(Exception):
        evaluate.aligned(a, b, "id").collect()
    parts = dict(values(spark.createDataFrame([("layers.3.attention.q_proj.weight",), ("layers.1.mlp.up_proj.weight",), ("embed_tokens.weight",), ("x",)], "n string").select("n", evaluate.tensor_group(F.col("n")).alias("g")), "n", "g"))
    assert list(parts.values()) == ["attention_q_proj", "mlp_up_proj", "tied_embedding", "other"]


def test_running_total_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("k"), "id", (F.col("id") % 13).alias("v"))
    got = {r.id: r.s for r in stage.running_total(df, ["k"], ["id"], F.col("v"), "s").collect()}
    upto, want = {}, {}
    for i in range(5000):
        k = i % 7 if i % 10 == 0 else None
        upto[k] = upto.get(k, 0) + i % 13
        want[i] = upto[k]
    assert got == want
    big = spark.range(10).withColumnRenamed("id", "j")
    assert "Broadcast" in stage.lookup(df, big, df.id == big.j)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in stage.lookup(df.hint("merge"), big, df.id == big.j, limit=0)._jdf.queryExecution().optimizedPlan().toString()


def test_similar_pairs_take_no_rows_for_unlike_ones(spark, monkeypatch):
    """All pairs of few and of frequent windows, as plain loops give them, and what the screen lets through stays near that."""
    import random

    from tessella.operators import corpus, near
    draw = random.Random(5)
    make = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz é\n😀") for _ in range(n))
    notice, near_ones = make(400), make(1500)
    texts = [make(draw.randrange(2000, 3000)) + notice for _ in range(60)] + [near_ones[:k] + make(80) for k in range(600, 1500, 60)] + [notice + make(60 + k) for k in range(12)] + [None, "", "short", "a" * 500]
    # The notice lies at multiples of 8, so that all documents share its windows.
    texts = [make(8 * (len(t) // 8) - len(notice)) + notice if t and t.endswith(notice) else t for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = corpus.pair_jaccard(docs, corpus.window_pairs(docs, 2, None))
    want = {tuple(r) for r in plain.where("similarity >= 0.3").collect()}
    seen, screen = [], near._screened
    monkeypatch.setattr(near, "_screened", lambda pairs, least: seen.append(pairs.count()) or screen(pairs, least))
    for often, block in ((32, 4096), (3, 7)):
        monkeypatch.setattr(near, "OFTEN", often)
        monkeypatch.setattr(near, "BLOCK", block)
        assert {tuple(r) for r in near.similar_pairs(docs, 0.3).collect()} == want
    assert len(want) > 100 and plain.count() > len(want) + 1500 and max(seen) < 1.2 * len(want)


def test_near_paragraphs_count_in_rows(spark):
    """Repeats count, each pair for itself; no plan has a row for each window."""
    a, b = "0123456789" * 6, "abcdefghijklmnopqrstuvwxyz" * 2
    docs = spark.createDataFrame([(1, f"{a}\n\n {b} "), (2, a), (3, None), (4, b + "\n" + "é" * 30 + "\nx")], "doc_id long, text string")
    judged = spark.createDataFrame([(1, 2, "paras"), (1, 4, "paras"), (4, 3, "paras"), (2, 1, "drop")], "loser long, winner long, action string")
    out = dedup.near_paragraphs(judged, docs)
    cut = lambda t: [t[k:k + 24] for k in range(0, len(t) - 23, 4)]
    text = {1: [a, b], 4: [b, "é" * 30, "x"]}
    whole = {2: a, 3: "", 4: b + "\n" + "é" * 30 + "\nx"}
    want = {(d, w, k, len(cut(p)), sum(x in set(cut(whole[w])) for x in cut(p))) for d, w in ((1, 2), (1, 4), (4, 3)) for k, p in enumerate(text[d])}
    assert set(values(out, "doc_id", "winner", "pos", "n", "hits")) == want
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString().replace("Generate explode(array(", "")


def test_neardup_losers_of_one_priority(spark, tmp_path):
    import random

    from tessella.plans import catalog
    draw = random.Random(8)
    texts = ["".join(draw.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(6000)) for _ in range(3)]
    rows = [(1, "src1", texts[0]), (2, "src2", texts[0] + "tail"), (3, "src3", texts[1]), (4, "src1", texts[1][:3000] + texts[2][:3000]), (5, "src5", texts[0]), (6, "src1", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.queries()["neardup_losers"](spark, str(tmp_path))
    assert values(out, "loser", "winner") == [(1, 2)]
    assert 0.99 <= out.first().similarity < 1

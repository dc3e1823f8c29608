"""The operators against plain re-implementations, and the parts of their methods."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import crf, decontamination, near_dedup, packing, quality, registry, secrets, suffix_dedup, toxicity, trigrams
from tessella.llm.sampling import fold

SF = "/root/testdata/sf0.01"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---- op5: queries derived from the regexes, and the whole scan ----

def test_trigram_queries_are_derived_and_never_too_strict():
    assert trigrams.derive("AKIA[A-Z0-9]+") == [["AKI", "KIA"]]
    assert trigrams.derive("[0-9a-f]{24,}") == []
    assert trigrams.derive("a*bcd|xyz+w") == [["bcd"], ["xyz"]]
    assert trigrams.derive("(ab){3}c") == [["aba", "abc", "bab"]]
    assert trigrams.derive("(?i)To(ken|tal)", True) == [["ken", "oke", "tok"], ["ota", "tal", "tot"]]
    rng = np.random.default_rng(3)
    for rule in secrets.RULES:
        clauses = rule.clauses()
        for _ in range(60):
            text = _sample(rule, rng)
            assert re.search(rule.regex, text), (rule.kind, text)
            seen = text.lower() if rule.ignore_case else text
            assert not clauses or any(all(g in seen for g in c) for c in clauses), (rule.kind, text)


def _sample(rule, rng):
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    if rule.kind == "assign":
        word = str(rng.choice(["password", "PassWD", "secret", "TOKEN", "api_key", "ApiKey"]))
        return word + str(rng.choice(["", '"', "'"])) + " " * int(rng.integers(0, 3)) + str(rng.choice([":", "="])) + " " * int(rng.integers(0, 3)) + pick("abcXYZ019+/", 8)
    return {"access": lambda: "AKIA" + pick("ABC019", 16), "hex": lambda: pick("0123456789abcdef", 30), "private": lambda: "-----BEGIN " + str(rng.choice(["", "RSA ", "EC "])) + "PRIVATE KEY-----",
            "bearer": lambda: str(rng.choice(["Bearer", "BEARER"])) + " " * int(rng.integers(1, 3)) + pick("abc.-_", 24), "github": lambda: "gh" + pick("pousr", 1) + "_" + pick("abcXYZ019", 36)}[rule.kind]()


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_scan(t):
    found = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    found.sort()
    return [sum(x[1] == k for x in found) for k in range(3)] + [hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in found).encode()).hexdigest()]


def test_secrets_against_re_on_all_documents(spark):
    full = " ".join(f"token=abcdef{i} AKIA{'Z' * 18}" for i in range(3000))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(rows_of(spark, [(None, "password=abcdef1234"), (-5, full), (-6, None), (-6, "é api_key: 'abcdefg' " + "a1" * 13)]))
    want = Counter((r.doc_id, *plain_scan(r.text or "")) for r in docs.collect())
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(docs).collect())
    assert got == want and sum(n for (i, a, *_), n in got.items() if a) > 10


# ---- op2: against plain dynamic programming ----

def words_of(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", low)


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, max(new)), new
    return best


def test_decontamination_against_plain_alignment(spark):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    items = [" ".join(rng.choice(vocab, int(rng.integers(6, 25)))) for _ in range(8)]
    texts = [None, ""]
    for k in range(40):
        w = words_of(items[k % 8])
        for _ in range(int(rng.integers(0, 8))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(vocab))
        texts.append(" ".join([*rng.choice(vocab, 30), *w, *rng.choice(vocab, 30)]))
    docs = rows_of(spark, [(i if i % 7 else None, t) for i, t in enumerate(texts)]).where("doc_id is not null")
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(items)], "item_id long, text string, score double")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        d = words_of(t or "")
        grams = {tuple(d[k:k + 3]) for k in range(len(d) - 2)}
        for j, item in enumerate(items):
            q = words_of(item)
            score = smith_waterman(q, d) / (2 * len(q))
            if i % 7 and score >= 0.5 and any(tuple(q[k:k + 3]) in grams for k in range(len(q) - 2)):
                want[i, j] = score
    assert set(got) == set(want) and len(want) > 15
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    none = decontamination.contaminated(rows_of(spark, [(None, items[0]), (None, items[0])]), bench).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in none] == [(None, 0, 1.0)]


# ---- op3, op4: documents' scores recomputed with an enumerated chain ----

def enumerated(odds, trans):
    """Marginals of a chain by adding up all label sequences."""
    n, total, ones = len(odds), 0.0, np.zeros(len(odds))
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        p = math.exp(sum(o for o, v in zip(odds, y) if v) + sum(trans[a][b] for a, b in zip(y, y[1:])))
        total += p
        ones += p * np.array(y)
    return ones / total


def test_quality_and_toxicity_scores_against_enumeration(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scale, weights, trans, last, prior = model = quality.fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    texts = ["One line.\nAnother | line &&&\n\n12345", "A B C\n" * 4, "", None, "word " * 40]
    got = {r.doc_id: r.score for r in quality.score(rows_of(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        x, doc, size = quality._lines(data, np.array([0, len(data)]))
        if not len(doc):
            assert got[i] == pytest.approx(prior)
            continue
        p = enumerated((x / scale) @ weights, trans)
        z = np.array([p @ size / size.sum(), p.min()])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(z @ last[:-1] + last[-1]))), rel=1e-6)
    tables, w2, t2, l2 = tox = toxicity.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    texts = ["one two three four", "", None, docs.join(labels.where("toxic = 1"), "doc_id").select(F.substring("text", 1, 60).alias("t")).first().t]
    got = {r.doc_id: r.score for r in toxicity.score(rows_of(spark, list(enumerate(texts))), tox).collect()}
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, _, rows, kinds = toxicity._tokens(data, np.array([0, len(data)]))
        p = enumerated(toxicity._features(kinds, rows, tables) @ w2, t2) if len(rows) else np.zeros(0)
        z = np.array([p.max() if len(p) else 0.0, math.log1p(p.sum())])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(z @ l2[:-1] + l2[-1]))), rel=1e-6)


def test_held_out_recall(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    got = toxicity.score(docs, model).join(labels.where("toxic is not null"), "doc_id").where(fold(F.col("doc_id"), 5) == 0).groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("share")).collect()
    share = {r.toxic: r.share for r in got}
    assert share[1] >= 0.85 and share[0] <= 0.02


def test_sample_is_bounded_in_bytes(spark):
    from tessella.llm.sampling import labelled

    docs = rows_of(spark, [(i, "x" * (1000 if i else 10**6)) for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    texts, y, totals = labelled(docs, labels, "toxic", F.lit(True), 2000, 5000)
    assert totals == [25, 25] and sorted(Counter(y).items()) == [(0, 5), (1, 5)] and {len(t.as_py()) for t in texts} == {1000}


# ---- op9: the fit, and ids ----

def test_patterns_place_most_pieces():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6, 0.9, 6000).astype(int), 1, 2048)
    hist = np.bincount(lengths, minlength=2049)
    out, left = packing.by_patterns(hist)
    placed = sum(n * len(p) for p, n in out)
    assert (sum(np.bincount(p, minlength=2049) * n for p, n in out) + left == hist).all() and (left >= 0).all()
    assert placed >= 0.6 * len(lengths)
    plan = packing.plan(hist)
    assert (sum(np.bincount(p, minlength=2049) * n for p, n in plan) == hist).all() and all(sum(p) <= 2048 for p, _ in plan)
    assert sum(n for _, n in plan) <= math.ceil(lengths.sum() / 2048) * 1.01 + 1


def test_both_encoders_give_the_same_ids():
    e = packing.Encoder(packing.default_tokenizer())
    assert e.quick is not None
    texts = [f"a{chr(c)}b {chr(c)}1 {chr(c)} x{chr(c)}{chr(c)}'s" for c in [*range(0x3000), 0x4E2D, 0xFFFD, 0x1F600]]
    texts += ["<|endoftext|>a<|endoftext|>", "a" * 5000 + " b", " " * 9000 + "x\n\n  y", "", "I'd 'S it's", "x" * 3999 + " " + "é" * 4500]
    slow = e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert all(np.asarray(s.ids, "<u4").tobytes() == q for s, q in zip(slow, e.encode(texts)))


# ---- op1, op10: made-up texts ----

def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_texts_that_make_polynomials_collide(spark):
    a, b = thue_morse(4096), thue_morse(4096, True)
    got = near_dedup.near_duplicates(rows_of(spark, [(1, a), (2, b)])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2}
    data = [a[:1024].encode(), b[:1024].encode()]
    seen = Counter(x[s:s + 400] for x in data for s in range(len(x) - 399))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(rows_of(spark, [(1, a[:1024]), (2, b[:1024])])).collect()}
    for i, x in enumerate(data, 1):
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - 399):
            if seen[x[s:s + 400]] > 1:
                gone[s:s + 400] = True
        assert got[i] == gone.sum()


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    one, two, both = text(900), text(1000), text(700)
    docs = rows_of(spark, [(1, one), (1, two), (None, both), (2, both), (3, "short"), (3, "short"), (None, None)])
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == Counter([(1, 900, 0), (1, 1000, 0), (None, 700, 700), (2, 700, 700), (3, 5, 0), (3, 5, 0), (None, 0, 0)])


# ---- clashing names, empty tables, the pipeline ----

NAMES = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, label int, sketch string, block int, mask long, kept boolean, h long"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 7, 1, "k", 3, 9, True, 4) for i, t in rows], NAMES)


def made_up(seed, n=120):
    rng = np.random.default_rng(seed)
    vocab = ["".join(np.random.default_rng(k).choice(list("klmnoprst"), 6)) for k in range(300)]
    return " ".join(rng.choice(vocab, n))


@pytest.fixture
def small(spark, tmp_path):
    """A folder with documents, labels and benchmark whose outcome is known."""
    base, item = made_up(1), made_up(2, 40)
    near = base.replace(base.split()[50], "changed", 1)
    rows = [(0, base), (1, base + "  "), (1, base + "  "), (2, near), (3, made_up(3)), (4, "Intro. " + item + " outro."), (5, None), (6, ""), (7, made_up(4)), (7, made_up(5)), (None, made_up(6)), (8, "vile scum " * 20 + made_up(7))]
    rows += [(100 + i, ("vile scum " * 6 if i % 2 else "") + made_up(50 + i, 60)) for i in range(80)]
    wide(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, 1, i % 2, 0.1) for i in range(80)], "doc_id long, quality int, toxic int, score double").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item, 1.0)], "item_id long, text string, score double").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_stages(spark, small):
    import corpus_pipeline as P
    from tessella.llm.common import materialize

    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        columns = docs.columns
        docs = materialize(stage(spark, docs, small))
        assert docs.columns == columns
        kept[name] = Counter(r.doc_id for r in docs.collect() if r.doc_id is None or r.doc_id < 100)
    assert kept["toxicity"] == Counter({0: 1, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, None: 1})
    assert kept["exact_dedup"] == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 2, None: 1})
    assert kept["near_dedup"] == Counter({1: 1, 3: 1, 4: 1, 5: 1, 7: 2, None: 1})
    assert kept["decontamination"] == Counter({1: 1, 3: 1, 5: 1, 7: 2, None: 1})
    got = [(r.doc_id, r.piece, r.length) for r in P.run(spark, small).collect()]
    assert {i for i, *_ in got if i is None or i < 100} == {1, 3, 5, 7, None}
    # The whole of what toxicity keeps is clean, and none of the clean labelled documents is lost.
    assert {i for i, *_ in got if i is not None and i >= 100} == {100 + i for i in range(0, 80, 2)}


def test_pipeline_of_empty_tables(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_clashing_names_and_empty_tables(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, F.lit(True))
    for some, n in ((docs, docs.count()), (docs.where("false"), 0)):
        for out in (quality.score(some, model), toxicity.score(some, None), secrets.scan(some), near_dedup.near_duplicates(some), suffix_dedup.remove_repeats(some)):
            assert out.count() == n


def test_listed_urls_are_exercised(spark):
    got = registry.op7_urls(spark, "/root/testdata/sf0.1").groupBy("listed").count().collect()
    assert {r.listed: r["count"] for r in got}[True] >= 20


def test_crf_lengths():
    chain = crf.Chain(np.array([3, 70, 1]))
    odds = np.random.default_rng(1).normal(size=74)
    trans = np.array([[0.3, -0.2], [0.1, 0.5]])
    p = chain.marginals(odds, trans)
    assert p[:3] == pytest.approx(enumerated(odds[:3], trans)) and p[73] == pytest.approx(1 / (1 + math.exp(-odds[73])))

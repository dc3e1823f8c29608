"""Secret scans by a trigram inverted index, with built-in functions only.

Each rule's regex is turned into a Boolean trigram query (``trigrams.derive``):
a disjunction of clauses, each a conjunction of trigrams that every match must
hold (in lower case where the rule ignores case). The index keeps postings
(trigram, doc_id) for the trigrams that some query needs. The postings of a
clause's trigrams are intersected, all clauses at once: a document is in the
intersection if it is in as many of the clause's lists as the clause has
trigrams. Only documents that fulfil a clause of a rule are verified with its
regex. A rule without mandatory trigrams scans every document.

Positions come from the pieces between matches: splitting at the regex and
listing its matches alternate, so running sums of their lengths are the
offsets in code points. Matches are summed in groups of about the root of
their number, so that a text full of matches costs its length times that root.

Defined results: null text counts as empty; spans of different kinds may
overlap and are listed by start, then by rule order; repeated rows are grouped
by doc_id only for the index and reported one by one, rows without a doc_id
likewise; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trigrams import derive


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    ignore_case: bool = False
    #: (group, least length) a match must have.
    least: tuple[int, int] = (0, 0)

    def clauses(self) -> list[list[str]]:
        """The Boolean query: a match holds all trigrams of one clause; empty: no mandatory trigrams."""
        return derive(self.regex, self.ignore_case)


#: The contract's kinds in order, then kinds of our own. Patterns are fixed values.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, (2, 6)),
    Rule("access", r"AKIA[A-Z0-9]+", False, (0, 20)),
    Rule("hex", r"[0-9a-f]{24,}", False, (0, 24)),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{20,}", True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: (trigram, folded, doc_id) for the trigrams of all queries."""
    wanted = sorted({(g, r.ignore_case) for r in rules for c in r.clauses() for g in c})
    folded = F.lower("text")
    hits = F.filter(F.array(*[F.when(F.contains(folded if fold else F.col("text"), F.lit(g)), F.struct(F.lit(g).alias("trigram"), F.lit(fold).alias("folded"))) for g, fold in wanted]), lambda x: x.isNotNull())
    return docs.select("doc_id", F.explode(hits).alias("p")).select("p.trigram", "p.folded", "doc_id")


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): the rules of which a clause's posting lists all hold the document."""
    asked = [(r.kind, n, len(c), g, r.ignore_case) for r in rules for n, c in enumerate(r.clauses()) for g in c]
    of_trigram: dict[tuple[str, bool], list] = {}
    for kind, n, size, g, fold in asked:
        of_trigram.setdefault((g, fold), []).append(F.struct(F.lit(kind).alias("rule"), F.lit(n).alias("clause"), F.lit(size).alias("size")))
    clauses = F.lit(None)
    for (g, fold), who in of_trigram.items():
        clauses = F.when((F.col("trigram") == g) & (F.col("folded") == fold), F.array(*who)).otherwise(clauses)
    lists = postings(docs, rules).distinct().select("doc_id", F.explode(clauses).alias("c")).select("doc_id", "c.*")
    met = lists.groupBy("doc_id", "rule", "clause").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where("n = size")
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


_NO_STEPS = "cast(array() as array<struct<gap:int,size:int,value:int>>)"
_NO_SPANS = "cast(array() as array<struct<start:int,ord:int,span:string>>)"


def _steps(rule: Rule) -> Column:
    """For each match of a rule in ``text``: the gap before it, its size, and the size of the group that has a least size."""
    group, _ = rule.least
    whole = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0))
    # A match taken by itself has the same groups: the rules don't look beyond it.
    value = F.transform(whole, lambda m: F.length(F.regexp_extract(m, rule.regex, group) if group else m))
    gaps = F.transform(F.slice(F.split("text", rule.regex, -1), 1, F.size(whole)), F.length)
    return F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))


def _spans(rule: Rule, order: int, steps: Column) -> Column:
    """Array of (start, order, span text) of the matches that ``steps`` gives."""
    none = F.expr(_NO_SPANS)

    def step(acc, x):
        low = acc["at"] + x["gap"]
        high = low + x["size"]
        span = F.struct(low.alias("start"), F.lit(order).alias("ord"), F.concat(F.lit(rule.kind + ":"), low.cast("string"), F.lit(":"), high.cast("string")).alias("span"))
        return F.struct(high.alias("at"), F.when(x["value"] >= rule.least[1], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def group(acc, k):
        inner = F.aggregate(F.slice(steps, k * width + 1, width), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.array_append(acc["groups"], inner["out"]).alias("groups"))

    # An array that grows is copied each time, so spans are gathered in groups of about the root of their number.
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(steps)))).cast("int")
    groups = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / width).cast("int"))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.expr("cast(array() as array<array<struct<start:int,ord:int,span:string>>>)").alias("groups"))
    return F.when(F.size(steps) > 0, F.flatten(F.aggregate(groups, start, group, lambda acc: acc["groups"]))).otherwise(none)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, counts and digests of base spans, and all spans."""
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = candidates(base, rules).withColumnRenamed("doc_id", "id")
    rows = base.join(met, base.doc_id.eqNullSafe(met.id), "left")
    steps = []
    for r in rules:
        due = F.coalesce(F.array_contains("rules", r.kind), F.lit(False)) if r.clauses() else F.col("text").rlike(r.regex)
        steps.append(F.when(due, _steps(r)).otherwise(F.expr(_NO_STEPS)).alias("m_" + r.kind))
    rows = rows.select("doc_id", *steps)
    rows = rows.select("doc_id", *[_spans(r, k, F.col("m_" + r.kind)).alias("s_" + r.kind) for k, r in enumerate(rules)])
    text = lambda kinds: F.array_join(F.transform(F.sort_array(F.concat(*["s_" + k for k in kinds])), lambda s: s["span"]), ",")
    return rows.select(
        "doc_id", *[F.size("s_" + k).cast("long").alias("n_" + k) for k in BASE],
        F.sha2(text(BASE), 256).alias("base_sha256"), text([r.kind for r in rules]).alias("spans"))

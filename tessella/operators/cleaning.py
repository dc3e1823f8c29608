"""Cleaning, classification and gates of source texts. Word lists are parameters of the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_PUNCTUATION = r"[\p{P}\s]+"


def years(t: Column, where: str = "head") -> Column:
    """Sorted distinct years: 18xx to 20xx, and years of the republic (民國) counted from 1911, in the first 3,000, last 1,500 or all characters."""
    t = {"head": F.substring(t, 1, 3000), "tail": F.right(t, F.lit(1500)), "all": t}[where]
    found = F.regexp_extract_all(t, F.lit(r"((?:18|19|20)\d{2})年?|民國\d{1,3}年"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: F.when(y.startswith("民國"), F.regexp_extract(y, r"(\d+)", 1).cast("int") + 1911).otherwise(F.substring(y, 1, 4).cast("int")))))


def publication_gate(original: Column, deaths: Column, last_year: int = 1945) -> Column:
    """pass, or quarantine: by the latest year of original publication, else by the author's latest year of death, else quarantine."""
    found = F.transform(F.regexp_extract_all(F.coalesce(original, F.lit("")), F.lit(r"\b(1[5-9]\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    latest = F.array_max(found)
    # A publication after the gate's year leaves the decision to the death years, as an unknown one does.
    return F.when(latest <= last_year, "pass").when(F.array_max(deaths) <= last_year, "pass").otherwise("quarantine")


def text_gate(t: Column, modern: str) -> tuple[Column, Column, Column]:
    """(clean text, status, reason): conversion marks and short tags go; modern terms reject before years do; years of 1946 or later reject."""
    clean = F.regexp_replace(F.regexp_replace(t, r"-\{([^{}]*?)\}-", "$1"), r"<[^>]{1,60}>", "")
    found = years(F.concat(F.substring(clean, 1, 3000), F.right(clean, F.lit(1500))), "all")
    late, known = F.array_max(found) >= 1946, F.exists(found, lambda y: (y >= 1900) & (y <= 1945))
    status = F.when(clean.rlike(modern) | late, "reject").otherwise("pass")
    reason = F.when(clean.rlike(modern), "modern").when(late, "late_year").when(known, "year_evidence").otherwise("no_year")
    return clean, status, reason


def first_match(t: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first (pattern, value) whose pattern the text holds."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(t.rlike(pattern), value).otherwise(out)
    return out


def book_class(title: Column, deaths: Column, modern: str, rules: list[tuple[str, str]], default: str = "1") -> Column:
    """Category 5 by title or by an author who died after 1840, else the first rule, else the default."""
    return F.when(title.rlike(modern) | (F.array_max(deaths) > 1840), "5").otherwise(first_match(title, rules, default))


def era_of(deaths: Column) -> Column:
    d = F.array_max(deaths)
    return F.when(d.between(1912, 1945), "roc").when((d >= 1840) & (d < 1912), "late_qing").when(d < 1840, "ming_qing").otherwise("unknown")


def mapped(key: Column, table: dict[str, str], default: str = "") -> Column:
    """A lookup in a small literal table (paths to categories, file stems to eras)."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def junk_title(title: Column, junk: str, longest: int = 120) -> Column:
    t = F.coalesce(T.strip(title), F.lit(""))
    return (t == "") | t.rlike(junk) | (F.length(t) > longest)


def filter_lines(t: Column, drop: str) -> Column:
    """Stripped lines that aren't blank and don't match ``drop``."""
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), T.strip), lambda x: (x != "") & ~x.rlike(drop)), "\n")


def between_markers(t: Column, start: str, end: str, credit: str = r"^\s*Produced by\b") -> Column:
    """Without the start marker itself, everything from the end marker on, and credit lines; what stands before the start marker stays."""
    t = F.regexp_replace(F.regexp_replace(t, start, ""), f"(?s){end}.*$", "")
    return F.array_join(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(credit)), "\n")


_POEM = "array<struct<title:string,author:string,paragraphs:array<string>,strains:array<string>>>"


def flatten_poems(t: Column) -> Column:
    """JSON poems (one object or a list; paragraphs or strains) to ``《title》 author`` and lines; other text stays as it is."""
    listed = F.when(F.ltrim(t).startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)
    poems = F.from_json(listed, _POEM)

    def one(p):
        head = F.when(F.coalesce(p["title"], F.lit("")) != "", F.trim(F.concat(F.lit("《"), p["title"], F.lit("》 "), F.coalesce(p["author"], F.lit("")))))
        lines = F.when(F.size(p["paragraphs"]) > 0, p["paragraphs"]).otherwise(F.coalesce(p["strains"], F.array().cast("array<string>")))
        return F.concat_ws("\n", head, F.array_join(lines, "\n"))

    return F.when(F.try_parse_json(t).isNull() | poems.isNull(), t).otherwise(F.array_join(F.transform(F.filter(poems, lambda p: p.isNotNull()), one), "\n\n"))


def strip_punctuation(t: Column) -> Column:
    """Without Unicode punctuation and white space."""
    return F.regexp_replace(t, "(?U)" + _PUNCTUATION, "")


def fold_script(t: Column, pairs: dict[str, str]) -> Column:
    """Characters folded by a supplied map; for keys only, stored text keeps its script."""
    return F.translate(t, "".join(pairs), "".join(pairs.values()))


def script_class(t: Column, pairs: dict[str, str]) -> Column:
    """simplified, traditional, mixed or identical, by which sides of the map the text holds."""
    old, new = "[" + "".join(pairs) + "]", "[" + "".join(pairs.values()) + "]"
    return F.when(t.rlike(old) & t.rlike(new), "mixed").when(t.rlike(old), "traditional").when(t.rlike(new), "simplified").otherwise("identical")


def safe_name(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("/"), F.lit("__")), F.lit("|"), F.lit("_"))


def gate(docs: DataFrame, least_chars: int = 50, least_ratio: float = 0.55, most_symbols: float = 0.25, script: str = "letters") -> DataFrame:
    """All rules of the cascade over (text, parse_status, time_status, time_reason, read_error, post_status); ``reason`` is the first that fails."""
    ratio = T.cjk_ratio(F.col("text")) if script == "cjk" else T.letter_ratio(F.col("text"))
    text = F.coalesce("text", F.lit(""))
    reason = (F.when(F.col("parse_status") != "ok", "parse_error").when(F.col("time_status") == "reject", F.concat(F.lit("time:"), F.coalesce("time_reason", F.lit(""))))
              .when(F.col("read_error").isNotNull(), "read_error").when(F.col("post_status") == "reject", "post_reject").when(F.length(text) < least_chars, "too_short")
              .when(ratio < least_ratio, "low_ratio").when(T.symbol_ratio(text) > most_symbols, "symbols").when(text.rlike(r"http://|www\."), "url"))
    return docs.withColumn("reason", reason)


def byte_guard(docs: DataFrame, most: float = 4.0) -> DataFrame:
    """Per source: characters before, bytes to store (three a character and 64 a row), and whether they are within ``most`` times."""
    g = docs.groupBy("source").agg(F.sum("chars_raw").alias("raw"), F.sum(F.length("text") * 3 + 64).alias("stored"))
    return g.withColumn("within", F.col("stored") <= F.col("raw") * most)


def guarded(docs: DataFrame, most: float = 4.0) -> DataFrame:
    """The same, raising an error where a source is over the limit."""
    return byte_guard(docs, most).withColumn("checked", F.assert_true(F.col("within"), F.concat(F.lit("too many bytes: "), F.col("source"))))

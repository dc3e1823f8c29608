"""Chat formatting by prefix-target expansion, with built-in functions only.

Every assistant turn becomes one example: all turns up to it in the template
``<|im_start|>role\\ntext<|im_end|>\\n``, of which only the reply's text is
trainable (``loss_start``, ``loss_length`` in code points). Turns after the
last reply form one example without trainable text, so nothing is lost.

Control strings inside texts are escaped reversibly: backslashes double, then
``<|`` becomes ``<\\|`` (and, in roles, a line feed becomes ``<\\n``). No
original backslash stays single, so ``<\\|`` has one reading.

The expansion writes each prefix again for every reply, as the method wants:
a conversation of n turns gives at most n examples of at most n turns, and a
conversation is the smallest unit that can be put in order. Conversations in
the data are short; one of unusual length costs the square of its own turns.

Defined results: null roles and texts count as empty; rows with equal turn
numbers are ordered by role, then text, and repeated rows all count; a
conversation without replies gives one untrained example; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    return _unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (number of turns in it), formatted, loss_start, loss_length."""
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    segments = F.transform("ts", lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"), _escape(t["text"]), F.lit(END)))
    replies = F.transform("ts", lambda t, i: F.struct((i + 1).alias("upto"), (t["role"] == "assistant").alias("reply"), F.length(_escape(t["text"])).alias("loss_length")))
    chosen = F.filter(replies, lambda r: r["reply"] | (r["upto"] == F.size("ts")))
    one = conv.select("conv_id", segments.alias("segments"), F.explode(chosen).alias("x"))
    text = F.array_join(F.slice("segments", 1, F.col("x.upto")), "")
    out = one.select("conv_id", F.col("x.upto").alias("example"), text.alias("formatted"), F.when(F.col("x.reply"), F.col("x.loss_length")).otherwise(0).alias("loss_length"), F.col("x.reply").alias("trained"))
    return out.withColumn("loss_start", F.when(F.col("trained"), F.length("formatted") - F.lit(len(END)) - F.col("loss_length")).otherwise(F.length("formatted")))


def read_back(made: DataFrame) -> DataFrame:
    """Digests of each conversation, taken only from the formatted examples."""
    target = _unescape(F.substr(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    conv = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), F.struct("example", target.alias("text"))))).alias("targets"))
    parts = F.split("whole", r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    turn = lambda p: F.concat(_unescape_role(F.substring_index(body(p), "\n", 1)), F.lit("\n"), _unescape(F.substr(body(p), F.instr(body(p), F.lit("\n")) + 1)), F.lit("\n"))
    loss = F.array_join(F.transform("targets", lambda t: t["text"]), "")
    return conv.select(
        "conv_id", F.size(parts).cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform(parts, turn), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_examples")

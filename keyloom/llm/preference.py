"""Preference formatting: the turns that a chosen and a rejected conversation share become the prompt; what follows are paired completions with loss masks.

Everything is DataFrame expressions. Turns are put together per pair (an output row holds the whole conversation, so that is the natural unit), in
the order of ``turn``, then role and text. The longest common turn prefix (same role and text) is rendered once. Each
completion is rendered with the spans (start, end in code points) that count for the loss: texts and end marks of the
trained role. Control marks inside texts are broken up, so a text can't end its turn.

A null role or text is empty; a null turn sorts first; a null id is one pair. Repeated turns stay repeated. If both sides are
equal, both completions are empty; if one is a prefix of the other, its completion is. A pair that has one side only has an
empty other side. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"
TURN = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame, *, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(id, turns): the ordered turns of each conversation."""
    one = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return turns.select(F.col(id_col).alias("id"), one.alias("one")).groupBy("id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def shared_turns(a: Column, b: Column) -> Column:
    """How many turns a and b have in common from the start."""
    differs = F.zip_with(a, b, lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])))
    first = F.array_position(differs, True)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1).cast("int")


def plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def head(x: Column) -> Column:
    return F.concat(F.lit("<|"), plain(x["role"]), F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(head(x), plain(x["text"]), F.lit(END + "\n"))), "")


def trained_spans(turns: Column, role: str) -> Column:
    """array<struct<start, end>> of the trained parts of ``rendered(turns)``."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(s, x):
        a = s["at"] + F.length(head(x))
        b = a + F.length(plain(x["text"])) + len(END)
        more = F.concat(s["spans"], F.array(F.struct(a.alias("start"), b.alias("end"))))
        return F.struct((b + 1).alias("at"), F.when(x["role"] == role, more).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, *, role="assistant") -> DataFrame:
    """From (id, chosen, rejected) with turn arrays: id, prompt_turns, prompt, chosen, rejected and the spans of both completions."""
    none = F.expr(f"cast(array() as {TURN})")
    p = pairs.select("id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    p = p.withColumn("n", shared_turns(F.col("c"), F.col("r")))

    def rest(x):
        return F.slice(F.col(x), F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))

    p = p.select("id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return p.select(
        "id", F.col("n").alias("prompt_turns"), rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"),
        trained_spans(F.col("c"), role).alias("chosen_spans"), trained_spans(F.col("r"), role).alias("rejected_spans"),
    )


def paired(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs from two tables of (id, turns) with one row an id."""
    return chosen.select("id", F.col("turns").alias("chosen")).join(rejected.select("id", F.col("turns").alias("rejected")), "id", "full_outer")


def stale_reply(turns: Column, role: str = "assistant") -> Column:
    """The conversation up to its last reply, which is replaced by the reply before (empty if there is none): a rejected side for tables that have none."""
    at = F.transform(turns, lambda x, i: F.when(x["role"] == role, i + 1))
    at = F.filter(at, lambda i: i.isNotNull())
    last = F.element_at(at, -1)
    old = F.when(F.size(at) > 1, F.element_at(turns, F.element_at(at, -2))["text"]).otherwise("")
    new = F.struct(F.element_at(turns, last)["turn"].alias("turn"), F.lit(role).alias("role"), old.alias("text"))
    return F.when(F.size(at) == 0, turns).otherwise(F.concat(F.slice(turns, F.lit(1), last - 1), F.array(new)))

"""Preference formatting: one prompt for the common turns of two conversations, masked completions for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written: ``open_role`` + role + ``close_role`` + text + ``end``."""

    open_role: str = "<|"
    close_role: str = "|>\n"
    end: str = "<|end|>\n"
    trained_role: str = "assistant"


def collect_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", name: str = "turns") -> DataFrame:
    """One row per conversation with its turns in order as ``array<struct<role, text>>``.

    Order is by turn, then role and text, null turns first; repeated rows stay.
    A null role reads ``unknown``, a null text is empty, a null conversation id
    is a conversation of its own.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(turn))
    return turns.groupBy(conv_col).agg(ordered.alias("__turns")).select(conv_col, F.transform("__turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns, from the first on, that are equal in role and text."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    equal = F.zip_with(F.slice(chosen, 1, F.greatest(shorter, F.lit(0))), F.slice(rejected, 1, F.greatest(shorter, F.lit(0))), lambda a, b: a.eqNullSafe(b))
    differ = F.array_position(equal, F.lit(False))
    return F.when(differ > 0, differ.cast("int") - 1).otherwise(shorter)


def rendered(turns: Column, template: Template) -> Column:
    """The turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(template.open_role), t["role"], F.lit(template.close_role), t["text"], F.lit(template.end))), "")


def trained_spans(turns: Column, template: Template) -> Column:
    """``array<struct<start, length>>``: characters of the rendered turns that count for the loss, in order.

    These are the texts of the trained role with the end mark that follows;
    role headers and all other turns are masked.
    """
    fixed = len(template.open_role) + len(template.close_role) + len(template.end)
    size = F.transform(turns, lambda t: F.length(t["role"]) + F.length(t["text"]) + F.lit(fixed))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, i: Column) -> Column:
        turn = F.get(turns, i)
        header = F.length(turn["role"]) + F.lit(len(template.open_role) + len(template.close_role))
        span = F.struct((state["at"] + header).cast("int").alias("start"), (F.length(turn["text"]) + F.lit(len(template.end))).cast("int").alias("length"))
        spans = F.when(turn["role"] == template.trained_role, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + F.get(size, i)).cast("int").alias("at"), spans.alias("spans"))

    numbers = F.when(F.size(turns) > 0, F.sequence(F.lit(0), F.size(turns) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, empty, step, lambda s: s["spans"])


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", template: Template = Template()) -> DataFrame:
    """Replaces two conversations by ``prompt``, ``chosen``, ``rejected`` and the spans that are trained.

    The prompt renders the longest common turn prefix once; the completions
    render what follows it, each with ``*_spans`` of :func:`trained_spans`.
    ``prompt_turns`` counts the common turns.  Equal conversations, and one
    that is the beginning of the other, have an empty completion; a null
    conversation counts as one without turns.  Other columns pass through;
    columns named as a result are replaced.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    held = pairs.withColumns({"__c": F.coalesce(chosen_col, none), "__r": F.coalesce(rejected_col, none)}).drop(chosen_col, rejected_col)
    held = held.withColumn("prompt_turns", common_turns(F.col("__c"), F.col("__r")))
    held = held.withColumn("__p", F.slice("__c", 1, F.col("prompt_turns")))
    rest = {c: F.slice(c, F.col("prompt_turns") + 1, F.size(c)) for c in ("__c", "__r")}
    held = held.withColumns(rest)
    return held.withColumns({
        "prompt": rendered(F.col("__p"), template), "chosen": rendered(F.col("__c"), template), "rejected": rendered(F.col("__r"), template),
        "chosen_spans": trained_spans(F.col("__c"), template), "rejected_spans": trained_spans(F.col("__r"), template),
    }).drop("__c", "__r", "__p")


def echo_pairs(conversations: DataFrame, turns_col: str = "turns") -> DataFrame:
    """Pairs from conversations without ratings: the last reply as given, against one that echoes the turn before it.

    ``chosen`` ends with the last assistant turn.  ``rejected`` is the same up
    to it and then answers with the text of the turn before (empty if there is
    none).  A conversation without assistant turn is its own counterpart.
    """
    turns = F.col(turns_col)
    last = F.size(turns) - F.array_position(F.reverse(F.transform(turns, lambda t: t["role"] == "assistant")), F.lit(True)).cast("int") + 1
    answered = F.exists(turns, lambda t: t["role"] == "assistant")
    before = F.slice(turns, 1, F.greatest(F.col("__last") - 1, F.lit(0)))
    echo = F.struct(F.lit("assistant").alias("role"), F.coalesce(F.get(turns, F.col("__last") - 2)["text"], F.lit("")).alias("text"))
    marked = conversations.withColumn("__last", F.when(answered, last))
    return marked.withColumns({
        "chosen": F.when(F.col("__last").isNull(), turns).otherwise(F.slice(turns, 1, F.coalesce("__last", F.lit(0)))),
        "rejected": F.when(F.col("__last").isNull(), turns).otherwise(F.concat(before, F.array(echo))),
    }).drop("__last")

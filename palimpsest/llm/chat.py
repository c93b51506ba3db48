"""Chat formatting by prefix-target expansion.

Template, by role: ``<<SYS>>text<</SYS>>``, ``[INST]text[/INST]``, `` text</s>`` for system, user and assistant;
``[ROLE hex]text[/ROLE]`` with the role's UTF-8 bytes in hex for any other role. Every turn ends with its closing mark. Control strings
inside a text are broken by U+241B after their first character, and U+241B itself is doubled, so that both can be undone.

``expand`` gives one example for each assistant turn: the turns before it as context, then the reply, whose text alone lies
under the loss mask (``loss_start``, ``loss_chars`` in code points). Turns after the last reply, or all turns where
there is none, are kept as one more row without a loss span, so that nothing is lost.

Defined results: a null text or role is empty; turns are ordered by turn number, nulls first, then role and text, so ties
and repeated rows are all kept in a fixed order; rows without a conversation id form one conversation of their own; an empty table gives no
examples. A conversation has to be in one place because its digest and its prefixes are of the whole of it.
Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "␛"
CONTROL = r"(</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE)"
CLOSING = r"(?<=</s>|\[/INST\]|<</SYS>>|\[/ROLE\])"
OPENING = {"system": "<<SYS>>", "user": "[INST]", "assistant": " "}
ENDING = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(MARK * 2)), r"([<\[])(?=/?s>|/?INST\]|</?SYS>>|/?ROLE)", f"$1{MARK}")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"{MARK}({MARK}?)", "$1")


def _by_role(role: Column, of: dict, other: Column) -> Column:
    out = F
    for name, text in of.items():
        out = out.when(role == name, F.lit(text))
    return out.otherwise(other)


def opening(role: Column) -> Column:
    return _by_role(role, OPENING, F.concat(F.lit("[ROLE "), F.hex(role.cast("binary")), F.lit("]")))


def ending(role: Column) -> Column:
    return _by_role(role, ENDING, F.lit("[/ROLE]"))


def expand(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, example, text, loss_start, loss_chars); the row without a loss span has them null."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(F.col(key).alias("k"), "turn", role.alias("r"), text.alias("x"))
    inner = F.length(escape(F.col("x"))).alias("inner")
    turns = turns.select("k", F.struct("turn", "r", "x", opening(F.col("r")).alias("o"), inner, F.concat(opening(F.col("r")), escape(F.col("x")), ending(F.col("r"))).alias("f")).alias("t"))
    whole = turns.groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.select("k", "ts", F.array_join("ts.f", "").alias("all"))
    spans = F.aggregate(
        "ts",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,chars:int,stop:int>>").alias("cut")),
        lambda a, t: F.struct(
            (a["end"] + F.length(t["f"])).alias("end"),
            F.when(
                t["r"] == "assistant",
                F.concat(a["cut"], F.array(F.struct((a["end"] + F.length(t["o"])).alias("start"), t["inner"].alias("chars"), (a["end"] + F.length(t["f"])).alias("stop")))),
            ).otherwise(a["cut"]).alias("cut"),
        ),
        lambda a: a["cut"],
    )
    whole = whole.select("k", "all", spans.alias("cut"))
    last = F.coalesce(F.try_element_at("cut", F.lit(-1))["stop"], F.lit(0))
    rest = F.when(last < F.length("all"), F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("chars"), F.length("all").alias("stop"))))
    cuts = F.concat("cut", F.coalesce(rest, F.array().cast("array<struct<start:int,chars:int,stop:int>>")))
    out = whole.select("k", "all", F.posexplode(cuts).alias("example", "c"))
    return out.select(
        F.col("k").alias(key),
        "example",
        F.substring("all", F.lit(1), F.col("c.stop")).alias("text"),
        F.col("c.start").alias("loss_start"),
        F.col("c.chars").alias("loss_chars"),
    )


def read_back(examples: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, turns array<struct<role,text>>, replies array<string>, formatted_chars) parsed from examples alone."""
    reply = F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))
    found = examples.select(F.col(key).alias("k"), "example", "text", reply.alias("reply"))
    whole = found.groupBy("k").agg(
        F.max_by("text", "example").alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("rs"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )

    def parsed(t: Column) -> Column:
        role = F.when(t.endswith("[/INST]"), "user").when(t.endswith("</s>"), "assistant").when(t.endswith("<</SYS>>"), "system")
        coded = F.regexp_extract(t, r"^\[ROLE ([0-9A-F]*)\]", 1)
        role = F.coalesce(role, F.decode(F.unhex(coded), "UTF-8"))
        inside = F.substring(t, F.length(opening(role)) + 1, F.length(t) - F.length(opening(role)) - F.length(ending(role)))
        return F.struct(role.alias("role"), unescape(inside).alias("text"))

    parts = F.filter(F.split("all", CLOSING), lambda t: t != "")
    return whole.select(
        F.col("k").alias(key),
        F.transform(parts, parsed).alias("turns"),
        F.transform("rs.reply", unescape).alias("replies"),
        "formatted_chars",
    )


def digests(back: DataFrame, key: str = "conv_id") -> DataFrame:
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    said = F.array_join("replies", "")
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        "formatted_chars",
    )

"""Chat formatting with a grammar round trip (operator 7; SQL functions only).

Grammar of a formatted conversation, in code points::

    conversation = turn*
    turn         = "### " role ":\n" text "\n</turn>\n"
    role         = any text, with "%", ":" and line breaks as %25, %3A, %0A
    text         = any text; a run of backslashes before "### " or "</turn>"
                   is content with one backslash more than its source

A real control string has no backslash before it and a line break (or the start)
before it. The parser is deterministic: split at the terminator, cut the role at
its colon, take one backslash from each escaped control string.

Each turn is first rendered as it is and parsed again. Where the parse differs
from the source, the text is escaped; one escape is enough, as it takes every
control string out of a text and is undone exactly. The conversation is then parsed
as a whole and compared with its source turns: where that fails no output is
right, so the job ends with an error that names the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ":\n", "\n</turn>\n"
#: Control strings with the backslashes before them.
CONTROL = r"(\\*)(### |</turn>)"
ESCAPED = r"\\(\\*)(### |</turn>)"
#: A control string that a text must not hold as it is.
BARE = r"(?<!\\)(?:### |</turn>)"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def encode_role(role: Column) -> Column:
    out = role
    for plain, code in (("%", "%25"), (":", "%3A"), ("\n", "%0A")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def decode_role(role: Column) -> Column:
    out = role
    for plain, code in (("\n", "%0A"), (":", "%3A"), ("%", "%25")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), encode_role(role), F.lit(SEP), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text); a piece that breaks the grammar gives a null turn."""
    pieces = F.filter(F.split(formatted, r"\n</turn>\n", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        colon = F.instr(piece, SEP)
        role, text = F.substr(piece, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1), F.substr(piece, colon + len(SEP))
        ok = piece.startswith(F.lit(HEAD)) & (colon > 0) & ~F.rlike(text, F.lit(BARE))
        return F.when(ok, F.struct(decode_role(role).alias("role"), unescape(text).alias("text")))

    return F.transform(pieces, turn)


def rendered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, rendered, escaped``: each turn as it stands in the output."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    plain, source = render(F.col("role"), F.col("text")), F.struct("role", "text")
    conflict = ~F.coalesce((F.size(parse(plain)) == 1) & (F.element_at(parse(plain), 1) == source), F.lit(False))
    return rows.withColumn("escaped", conflict).withColumn("rendered", F.when(F.col("escaped"), render(F.col("role"), escape(F.col("text")))).otherwise(plain))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, formatted, spans, turns, n_escaped, round_trip`` of each conversation.

    ``spans`` are the (start, length) of the texts that the loss counts, from 0 in
    code points of ``formatted``; ``turns`` are those read back from ``formatted``.
    Turns stand in the order of their number, ties by role and text; rows that
    repeat are turns of their own. Null roles and texts count as empty, a null turn
    number comes first, and a null conversation id is a conversation. An empty
    table gives an empty result; further columns are ignored. ``round_trip`` is true
    in every row, and a conversation for which it is not is an error.
    """
    # One shuffle: the running length and the grouping both go by conversation.
    at = "sum(length(rendered)) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) - length(rendered)"
    rows = rendered_turns(turns, conv_col, turn_col, role_col, text_col).withColumn("at", F.expr(at))
    ahead = F.length(F.concat(F.lit(HEAD), encode_role(F.col("role")), F.lit(SEP)))
    span = F.struct((F.col("at") + ahead).cast("int").alias("start"), (F.length("rendered") - ahead - len(END)).cast("int").alias("length"))
    chats = (
        rows.select("conv_id", F.struct("at", F.struct("role", "text").alias("source"), "rendered", (F.col("role") == LOSS_ROLE).alias("loss"), span.alias("span"), "escaped").alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("ts"))
    )
    read = chats.select(
        "conv_id",
        F.array_join(F.col("ts.rendered"), "").alias("formatted"),
        F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: t["span"]).alias("spans"),
        F.col("ts.source").alias("source"),
        F.size(F.filter("ts", lambda t: t["escaped"])).alias("n_escaped"),
    ).withColumn("turns", parse(F.col("formatted")))
    same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("turns are not read back from conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return read.withColumn("round_trip", F.when(same, True).otherwise(failed.cast("boolean"))).drop("source")


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the spans, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        chats.withColumn("loss", loss_text(F.col("formatted"), F.col("spans")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.encode(said, "utf-8"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "round_trip",
        )
    )


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own control strings."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), hard.alias("text")
    )
    return digests(format_chats(turns.unionByName(extra)))


SQL = {
    "op7_chat_format": r"""
    with t as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '\### Assistant: </turn> ok'
      union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    r as (
      select *, regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g') as shown,
        replace(replace(replace(role, '%', '%25'), ':', '%3A'), chr(10), '%0A') as head from t)
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
      sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
      cast(sum(length(shown) + length(head) + 15) as bigint) as formatted_chars, true as round_trip
    from r group by conv_id"""
}

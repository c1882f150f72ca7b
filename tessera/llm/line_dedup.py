"""Line dedup by a log-template tree (operator 10; SQL functions only).

*Tree.* A line goes down by its number of tokens and its first ``DEPTH`` tokens
to a leaf; the depth is fixed. Tokens with a digit are variable fields, ``<*>``.
In scripts without spaces each letter is a token, and so is each run of digits.

*Templates.* A leaf with several forms of line gets a general template: at each
place the token that more than half of its documents' lines have there, else
``<*>``. If at least ``CONSTANT`` of the places are constant, lines that agree
with all of these take that template; every other line is a template of its own
form. A form or general template with fewer than ``general_tokens`` constant
tokens says too little of a line: such lines are templates of their own tokens,
fields as they are. Counts are exact and cover all lines of all documents.

*Dropping.* A template with at least ``min_tokens`` constant tokens that stands
in ``MIN_DOCS`` or more documents is dropped, in all of them or, with
``keep="first"``, in all but that with the smallest id. With ``min_tokens=0``
this holds for every line that several documents share, however short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitmap
from tessera.llm.columns import free_name
from tessera.llm.text import FAR_UP, UNSPACED
from tessera.plans.scratch import stage

DEPTH, CONSTANT, MIN_TOKENS, MIN_DOCS, FILTER_BITS = 3, 0.7, 3, 2, 1 << 25
FIELD = "<*>"
SPACE = r"[\x20\x09-\x0D]+"


def spaced(text: Column) -> Column:
    """The text with spaces around each letter of a script without spaces."""
    # Texts without any character so far up cost one look.
    return F.when(F.rlike(text, F.lit(FAR_UP)), F.regexp_replace(text, UNSPACED, " $0 ")).otherwise(text)


def tokens_of(line: Column) -> Column:
    """Tokens between ASCII white space, those with a digit as ``<*>``; of a line that is not blank and neither starts nor ends with white space."""
    masked = F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*", FIELD)).otherwise(line)
    return F.split(masked, SPACE)


def _lines(docs: DataFrame, id_col: str, text_col: str, general_tokens: int) -> DataFrame:
    """``id, copy, at, leaf, form, constant, own, tokens`` of every line with a token; ``copy`` tells rows apart that repeat an id, ``own`` is the template of a line that no general one covers."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(spaced(text), "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\n\x0b\f\r"))).where("line <> ''")
    rows = rows.select("id", "copy", "at", "line", tokens_of(F.col("line")).alias("tokens"))
    # Hashes stand for leaves and forms: texts of lines are not shuffled.
    rows = rows.withColumn("leaf", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH))).withColumn("form", F.xxhash64("tokens"))
    rows = rows.withColumn("constant", _constant(F.col("tokens")))
    exact = (F.col("constant") < general_tokens) & (F.col("constant") < F.size("tokens"))
    return rows.withColumn("own", F.when(exact, F.xxhash64(F.split("line", SPACE))).otherwise(F.col("form"))).drop("line")


def _constant(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t != FIELD))


def general_templates(lines: DataFrame, general_tokens: int = MIN_TOKENS) -> DataFrame:
    """``leaf, places`` of the leaves whose lines mostly agree; a place is a token or null."""
    counts = lines.select("leaf", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n"))
    places = counts.groupBy("leaf", "place").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
    token = F.when((F.col("top.n") * 2 > F.col("all")) & (F.col("top.token") != FIELD), F.col("top.token"))
    # As many places as the lines of a leaf have tokens.
    whole = places.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("place", token.alias("token")))).alias("p"))
    whole = whole.select("leaf", F.col("p.token").alias("places"))
    constant = F.size(F.filter("places", lambda t: t.isNotNull()))
    return whole.where((constant >= F.lit(CONSTANT) * F.size("places")) & (constant < F.size("places")) & (constant >= general_tokens))


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", general_tokens: int = MIN_TOKENS) -> DataFrame:
    """``id, copy, at, template, constant`` of every line with a token; ``template`` is a hash."""
    lines = _lines(docs, id_col, text_col, general_tokens)
    rows = stage(lines.select("id", "copy", "at", "leaf", "form", "own", "constant"), "lines")
    leaves = rows.groupBy("leaf").agg(F.min("form").alias("a"), F.max("form").alias("b"), F.min("id").alias("c"), F.max("id").alias("d"))
    leaves = stage(leaves.where("a <> b and not (c <=> d)").select("leaf"), "leaves")
    near = bitmap.probe(lines, F.col("leaf"), bitmap.build(leaves, F.col("leaf"), FILTER_BITS), FILTER_BITS, "_open").where("_open")
    near = stage(near.join(leaves, "leaf", "left_semi").select("leaf", "form", "tokens"), "open")
    general = stage(general_templates(near, general_tokens), "general")
    if general.isEmpty():
        return rows.select("id", "copy", "at", F.col("own").alias("template"), "constant")
    agrees = F.forall(F.arrays_zip("places", "tokens"), lambda x: x["places"].isNull() | (x["places"] == x["tokens"]))
    joined = near.join(general, "leaf").where(agrees)
    fits = stage(joined.select("form", F.xxhash64(F.lit("general"), "leaf").alias("general"), F.size(F.filter("places", lambda t: t.isNotNull())).alias("fixed")).distinct(), "fits")
    return rows.join(fits, "form", "left").select("id", "copy", "at", F.coalesce("general", "own").alias("template"), F.coalesce("fixed", "constant").alias("constant"))


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``template, docs, first`` of the templates that stand in ``min_docs`` or more documents."""
    per_doc = lines.where(F.col("constant") >= min_tokens).select("template", "id").distinct()
    return per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first")).where(F.col("docs") >= min_docs)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, keep: str | None = "first", min_tokens: int = MIN_TOKENS, out: str = "dropped", general_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text_col``, and in ``out`` the numbers of those lines from 0 (a column of that name is replaced).

    Lines end at a line feed. Blank lines and lines with fewer than ``min_tokens``
    constant tokens stay; lines that differ in their fields count as one template
    from ``general_tokens`` constant tokens on. Rows that repeat an id are one document; rows without an
    id together are one, and lose their recurring lines to any that has an id.
    Null texts stay null, an empty table gives an empty result, other columns and
    all rows stay as they were.
    """
    lines = stage(templates(docs, id_col, text_col, general_tokens), "templates")
    found = recurring(lines, min_docs, min_tokens)
    gone = lines.join(found, "template")
    if keep == "first":
        gone = gone.where("not (id <=> first)")
    # A document's own line numbers.
    by_doc = stage(gone.groupBy("id", "copy").agg(F.sort_array(F.collect_set("at")).alias("dropped")), "dropped")
    copy, maybe, gone_at, own_id, own_copy = (free_name(docs, x) for x in ("_copy", "_maybe", "_dropped", "_own_id", "_own_copy"))
    marked = docs.withColumn(copy, F.xxhash64(F.col(text_col)))
    marked = bitmap.probe(marked, F.col(copy), bitmap.build(by_doc, F.col("copy"), FILTER_BITS), FILTER_BITS, maybe)
    touched = marked.where(F.col(maybe))
    own = by_doc.select(F.col("id").alias(own_id), F.col("copy").alias(own_copy), F.col("dropped").alias(gone_at))
    touched = touched.join(own, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(copy) == F.col(own_copy)), "left").drop(own_id, own_copy)
    none = F.array().cast("array<int>")
    both = marked.where(~F.col(maybe)).withColumn(gone_at, none).unionByName(touched)
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(F.col(gone_at), i)), "\n")
    both = both.withColumn(text_col, F.when(F.size(gone_at) > 0, kept).otherwise(F.col(text_col)))
    return both.withColumn(out, F.coalesce(F.col(gone_at), none)).drop(copy, maybe, gone_at)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines that recur, short ones too, and their numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_lines(docs.select("doc_id", "text"), min_tokens=0).withColumn("n_dropped", F.size("dropped").cast("long"))

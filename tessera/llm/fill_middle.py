"""Fill-in-middle transformation with DuckDB inside Arrow batches (operator 12).

Each Arrow batch is registered with an embedded DuckDB and one statement turns it
into the result: ``regexp_extract_all`` cuts a text into pieces of ``PIECE`` code
points, only the two pieces that hold a cut are taken apart further, ``list_slice``
and ``array_to_string`` put the three spans together, and ``sha256`` draws. No row
passes through Python. A batch is handed on in parts of ``PART_BYTES`` of text, so
memory is bounded by that and by the longest text.

*Draws.* h1 to h4 are the first four groups of eight hexadecimal digits of
sha256(seed || ':' || id). The prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) code points, the middle after the larger.

*Forms.* ``plain``: the text as it is, where it is empty, holds a sentinel, or
h3 % 100 is not below ``percent``. ``spm`` where h4 % 100 is below
``spm_percent``: <S>suffix<P>prefix<M>middle. Else ``psm``:
<P>prefix<S>suffix<M>middle. A text with sentinels is plain, so an output can
always be read back (``restore``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a piece, and bytes of text that DuckDB gets at a time (one text at least).
PIECE, PART_BYTES = 64, 8 << 20
SENTINELS = ("<P>", "<S>", "<M>")
SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def statement(seed: int = 1, percent: int = 90, spm_percent: int = 20) -> str:
    """The SQL that turns the registered ``held`` (id, text) into rows of ``SCHEMA``."""
    points = lambda piece: f"regexp_extract_all({piece}, '(?s).')"
    joined = lambda items, first, last: f"array_to_string(list_slice({items}, {first}, {last}), '')"
    number = lambda i: f"cast('0x' || substr(hex, {8 * i + 1}, 8) as bigint)"
    sentinel = " or ".join(f"contains(t, '{s}')" for s in SENTINELS)
    return f"""
    with texts as (select id, coalesce(text, '') as t, sha256('{int(seed)}:' || coalesce(cast(id as varchar), '')) as hex from held),
    cut as (select *, regexp_extract_all(t, '(?s).{{1,{PIECE}}}') as pieces from texts),
    sized as (select *, case when len(pieces) = 0 then 0 else {PIECE} * (len(pieces) - 1) + len({points("pieces[-1]")}) end as n from cut),
    drawn as (
      select *, least({number(0)} % (n + 1), {number(1)} % (n + 1)) as a, greatest({number(0)} % (n + 1), {number(1)} % (n + 1)) as b,
        case when n = 0 or {sentinel} or {number(2)} % 100 >= {int(percent)} then 'plain' when {number(3)} % 100 < {int(spm_percent)} then 'spm' else 'psm' end as form
      from sized),
    placed as (select *, a // {PIECE} + 1 as i, b // {PIECE} + 1 as j, a % {PIECE} as u, b % {PIECE} as v from drawn),
    opened as (select *, {points("coalesce(pieces[i], '')")} as first, {points("coalesce(pieces[j], '')")} as last from placed),
    spans as (
      select id, n, form, a, b, t, {joined("pieces", 1, "i - 1")} || {joined("first", 1, "u")} as prefix,
        case when i = j then {joined("first", "u + 1", "v")} else {joined("first", "u + 1", PIECE)} || {joined("pieces", "i + 1", "j - 1")} || {joined("last", 1, "v")} end as middle,
        {joined("last", "v + 1", PIECE)} || {joined("pieces", "j + 1", "len(pieces)")} as suffix
      from opened)
    select cast(id as bigint) as id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
      case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output
    from spans"""


def _parts(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """The batch in parts of ``PART_BYTES`` of text, one row at least."""
    table = pa.Table.from_batches([batch])
    ends = table["bytes"].to_numpy().cumsum()
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(ends.searchsorted(done + PART_BYTES, side="right")))
        yield table.slice(start, end - start).select(["id", "text"])
        start = end


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of each row of ``docs``.

    ``n`` counts code points; the two counts of spans are null in plain rows. A null
    text counts as empty, an empty text is plain, and a null id draws as an empty
    one. Rows that repeat an id are each transformed, with the same draws. An empty
    table gives an empty result; further columns are ignored.
    """
    sql = statement(seed, percent, spm_percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False}) as con:
            for batch in batches:
                for part in _parts(batch):
                    con.register("held", part)
                    yield from con.sql(sql).to_arrow_table().cast(_ARROW).to_batches()
                    con.unregister("held")

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    spans = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.element_at(spans, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(2), at(4), at(3))).when(form == "spm", F.concat(at(3), at(4), at(2)))


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Every document, whole; digests of the outputs and of the texts read back from them."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return out.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


SQL = {
    "op12_fill_middle": """
    with t as (select doc_id, coalesce(text, '') as t, sha256('1:' || cast(doc_id as varchar)) as hex from documents),
    h as (select *, cast(length(t) as bigint) as n, cast('0x' || hex[1:8] as bigint) as h1, cast('0x' || hex[9:16] as bigint) as h2, cast('0x' || hex[17:24] as bigint) as h3, cast('0x' || hex[25:32] as bigint) as h4 from t),
    c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
    s as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from c)
    select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
      sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from s"""
}

r"""Chat formatting with a grammar round trip, with DataFrame functions only.

    conversation := turn*
    turn         := '<s>[INST]' role '[/INST]' text '</s>'

Role and text hold none of the four marks. A conversation is first rendered as it is and parsed again; if the parser's turns
are not the source's (a text holds a mark or something that reads as an escape), all of its roles and texts are escaped and the
outcome is parsed again, which must now give the source or the job fails. Escapes are a backslash and a letter; a backslash
itself is \e, so that no other escape can arise by accident and the parser can undo them one kind after the other, \e last.

The output row holds the formatted text and the loss mask: spans (start, length in code points) of the assistants' texts.

Edge cases: null role or text is empty; rows stand by turn (null first), then role and text, repeated rows each count; a null
conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored. One conversation's turns meet in
one task, since its output is one string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexibrook.llm.common import table

OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPES = (("\\", "\\e"), (CLOSE, "\\c"), (OPEN, "\\o"), (TEXT, "\\j"), (ROLE, "\\i"))
MARKS = r"</?s>|\[/?INST\]"


def escape(x: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ESCAPES, x)


def unescape(x: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(ESCAPES), x)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN + ROLE), role, F.lit(TEXT), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; an element is null where the grammar doesn't hold."""
    parts = F.split(formatted, CLOSE)
    head, sep = len(OPEN + ROLE), len(TEXT)

    def turn(p: Column) -> Column:
        rest = F.substring(p, F.lit(head + 1), F.length(p))
        at = F.locate(TEXT, rest)
        role, text = F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + sep, F.length(rest))
        good = p.startswith(OPEN + ROLE) & (at > 0) & ~role.rlike(MARKS) & ~text.rlike(MARKS)
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, escaped, spans) of conversations(conv_id, turn, role, text)."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = len(OPEN + ROLE + TEXT + CLOSE)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    for kind, f in (("raw", lambda c: c), ("esc", escape)):
        whole = F.length(f(F.col("role"))) + F.length(f(F.col("text"))) + marks
        rows = rows.withColumn(f"end_{kind}", F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE)).withColumn(f"len_{kind}", F.length(f(F.col("text"))))
    nth = F.row_number().over(order).alias("nth")
    whole = rows.select("*", nth).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "role", "text", "end_raw", "len_raw", "end_esc", "len_esc"))).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    raw = whole.withColumn("source", source).withColumn("raw", F.array_join(F.transform("turns", lambda t: render(t.role, t.text)), ""))
    raw = raw.withColumn("escaped", ~F.coalesce(parse(F.col("raw")) == F.col("source"), F.lit(False)))
    done = raw.withColumn("formatted", F.when(F.col("escaped"), F.array_join(F.transform("turns", lambda t: render(escape(t.role), escape(t.text))), "")).otherwise(F.col("raw")))
    held = ~F.col("escaped") | F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    done = done.withColumn("formatted", F.when(held, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation did not survive its round trip"))))

    def span(t: Column) -> Column:
        end, n = (F.when(F.col("escaped"), t[f"{x}_esc"]).otherwise(t[f"{x}_raw"]) for x in ("end", "len"))
        return F.struct((end - n).alias("start"), n.cast("long").alias("length"))

    spans = F.transform(F.filter("turns", lambda t: t.role == trained_role), span)
    return done.select("conv_id", "formatted", "escaped", spans.alias("spans"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chats(turns).withColumn("turns", parse(F.col("formatted")))
    masked = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    out = out.withColumn("loss", masked)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    return reduce(lambda c, p: f"replace({c}, '{p[0]}', '{p[1]}')", ESCAPES, x)


_CONFLICT = " OR ".join(f"contains({c}, '{m}')" for c in ("role", "text") for p in ESCAPES for m in (p[1], p[0]) if m != "\\")
OP5 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (CASE WHEN bool_or({_CONFLICT}) THEN sum({len(OPEN + ROLE + TEXT + CLOSE)} + length({_sql_escape('role')}) + length({_sql_escape('text')}))
    ELSE sum({len(OPEN + ROLE + TEXT + CLOSE)} + length(role) + length(text)) END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

QUERIES, SQL = {"op5_chat": op5_chat}, {"op5_chat": OP5}

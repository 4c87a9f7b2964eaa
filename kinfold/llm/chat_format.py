"""Chat formatting by a grammar round trip; only DataFrame functions.

A conversation is rendered as a header line and a turn for each row, ``### role: text</turn>``. A
deterministic parser reads the rendered text back; if its turns are not the source's, because a text
holds control strings, the conversation is rendered again with these escaped, and read back again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grammar. The header tells the parser whether backslashes escape.
HEADERS = ("<chat>\n", "<chat escaped>\n")
OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
MARK = "###"
RUN = 256  # turns whose ends are summed at a time


def escaped(text: Column, role: bool = False) -> Column:
    """Backslashes doubled, then one before each mark and inside each closing tag."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(MARK), F.lit("\\#\\#\\#"))
    out = F.replace(out, F.lit(CLOSE), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(SEP), F.lit(":\\ ")) if role else out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def render(turns: Column, escape: bool) -> Column:
    role = (lambda c: escaped(c, True)) if escape else (lambda c: c)
    text = escaped if escape else (lambda c: c)
    body = F.transform(turns, lambda t: F.concat(F.lit(OPEN), role(t["role"]), F.lit(SEP), text(t["text"]), F.lit(CLOSE + "\n")))
    return F.concat(F.lit(HEADERS[escape]), F.array_join(body, ""))


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where a lambda uses it again and again."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(sizes: Column, gap: int, start: Column) -> Column:
    """Where each of pieces of these sizes ends, a gap after each.

    Sums run inside runs of ``RUN`` pieces and then over the runs, since a fold copies its array at every step.
    """
    fold = lambda x, first, size, before: F.aggregate(x, F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, e: F.struct((acc["at"] + size(e) + (0 if before else gap)).cast("int").alias("at"), F.array_append(acc["out"], (acc["at"] + (0 if before else size(e))).cast("int")).alias("out")))

    def summed(own: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.size(own), F.lit(RUN)), lambda at: fold(F.slice(own, at, RUN), F.lit(0), lambda e: e, False))
        return _let(inner, lambda part: F.flatten(F.zip_with(part, fold(part, start, lambda p: p["at"], True)["out"], lambda p, at: F.transform(p["out"], lambda e: e + at))))

    return _let(sizes, lambda own: F.when(F.size(own) > 0, summed(own)).otherwise(F.array().cast("array<int>")))


def parse(formatted: Column) -> Column:
    """Read turns back as array<struct<role, text, start, end>>; null where the text is not in the grammar.

    start and end bound a turn's text, as it is written, in characters of the formatted text.
    """
    escape = F.startswith(formatted, F.lit(HEADERS[1]))
    head = F.when(escape, F.lit(len(HEADERS[1]))).when(F.startswith(formatted, F.lit(HEADERS[0])), F.lit(len(HEADERS[0])))
    parts = F.split(F.substr(formatted, head + 1), CLOSE + "\n", -1)
    pieces = F.slice(parts, 1, F.size(parts) - 1)
    cut = lambda p: F.instr(p, SEP)
    good = lambda p: F.startswith(p, F.lit(OPEN)) & (cut(p) > 0) & (F.instr(F.substr(p, F.lit(2)), MARK) == 0) & (F.instr(p, CLOSE) == 0)
    back = lambda s: F.when(escape, unescaped(s)).otherwise(s)
    ends = _running(F.transform(pieces, lambda p: F.length(p)), len(CLOSE) + 1, head)
    read = F.zip_with(
        pieces,
        ends,
        lambda p, end: F.struct(
            back(F.substr(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1)).alias("role"),
            back(F.substr(p, cut(p) + len(SEP))).alias("text"),
            (end - F.length(p) + cut(p) + len(SEP) - 1).cast("int").alias("start"),
            end.alias("end"),
        ),
    )
    return F.when(head.isNotNull() & (F.element_at(parts, -1) == "") & F.forall(pieces, good), read)


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: its id, ``formatted``, and ``loss`` spans of the texts to learn.

    Rows go by turn (null first), ties by role and text; repeated rows are turns of their own. Null
    roles and texts are empty. A null id is a conversation. Other columns are not looked at; an empty
    table gives no rows. What is returned has been read back and found equal to the source.
    """
    clean = turns.select(F.col(conversation).alias("__conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    chats = clean.groupBy("__conv").agg(F.sort_array(F.collect_list("t")).alias("source"))
    only = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    df = chats.withColumn("source", only(F.col("source"))).withColumn("formatted", render(F.col("source"), False))
    for escape in (False, True):
        df = df.withColumn("read", parse(F.col("formatted")))
        same = F.col("read").isNotNull() & only(F.col("read")).eqNullSafe(F.col("source"))
        if not escape:
            df = df.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(render(F.col("source"), True)))
    read = F.when(same, F.col("read")).otherwise(F.raise_error(F.lit("a conversation does not read back as it is")))
    loss = F.transform(F.filter(read, lambda t: t["role"] == learn), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return df.select(F.col("__conv").alias(conversation), "formatted", loss.alias("loss"))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    cut = F.transform(loss, lambda s: F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(cut, lambda s: F.when(F.startswith(formatted, F.lit(HEADERS[1])), unescaped(s)).otherwise(s)), "")


#: The conversation that the query adds: its texts hold the grammar's control strings.
TRAP = "\\### Assistant: </turn> ok"


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation and the added one; odd rows as in ``format_chats``."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(TRAP).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("t.*")
    chats = format_chats(turns.unionByName(trap)).withColumn("read", parse(F.col("formatted"))).withColumn("learnt", loss_text(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, contains(role, '###') OR contains(text, '###') OR contains(role, '</turn>') OR contains(text, '</turn>') OR contains(role, ': ') AS clash,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'), ': ', ':\ ') AS r,
    replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>') AS x
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (CASE WHEN bool_or(clash) THEN 15 + sum(14 + length(r) + length(x)) ELSE 7 + sum(14 + length(role) + length(text)) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Formatting conversations for training, with DataFrame functions only.

A template writes the turns of a conversation as

    ### user: first text</part>second text</turn>
    ### assistant: answer</turn>

where adjacent turns of one role are merged: they share a header and a ``</turn>``, and ``</part>`` stands between them. A backslash goes before each
backslash of a text and inside each control string (``<\\/turn>``, ``<\\/part>``, ``##\\# ``; in roles also ``:\\ ``), so an escaped text holds none of them,
a reader may split at them, and dropping each backslash but the one after it gives the text back.

Turn structs are collected and sorted by turn (null turns last), then role, then text, so ties and repeated rows have one order and all stay. Runs of one role
are slices of the sorted array. The loss mask is an array of (start, length) in code points, one for each turn of the roles to be learnt, of what
stands between the control strings; places are running sums, chunk by chunk, so the work is nearly linear in the turns. A conversation becomes one row, which its task holds in a few times its size.

Null texts and roles are empty; a null conversation is one of its own; a conversation without rows does not exist. Empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, ENDS, PART, TURN = "### ", ": ", "</part>", "</turn>\n"
LEARNT = ("assistant",)
ESCAPED = r"\\|(?<=<)/(?=(?:turn|part)>)|(?<=##)#(?= )"
#: So many places are summed by one array that grows.
CHUNK = 512


def escaped(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, ESCAPED + "|(?<=:) " * role, r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _running(values: Column) -> Column:
    """values: a column (not an expression) of an array of longs. The sum of what stands before each."""
    push = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    n = F.size(values)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))
    bases = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)), F.array(F.lit(0).cast("long")), push)
    inside = F.zip_with(chunks, bases, lambda c, base: F.when(c.isNull(), F.array().cast("array<bigint>")).otherwise(F.slice(F.aggregate(c, F.array(base), push), 1, F.size(c))))
    return F.flatten(inside)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """conv_id, formatted, loss: the conversations (rows: one a turn) as text, and which of it is to be learnt, as (start, length) from 0 in code points."""
    named = F.coalesce(rows[role].cast("string"), F.lit(""))
    turns = rows.select(
        rows[conv].alias("conv_id"), F.struct(rows[turn].isNull().alias("last"), rows[turn].alias("turn"), named.alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    t, n = F.col("t"), F.size("t")
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda x: F.struct(escaped(x["role"], role=True).alias("role"), x["role"].isin(*learnt).alias("learnt"), escaped(x["text"]).alias("text"))).alias("t"))
    # Where runs of one role begin (one more at the end).
    starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    chats = chats.select("conv_id", "t", starts.alias("runs"))
    runs = F.col("runs")
    merged = F.transform(F.sequence(F.lit(0), F.size(runs) - 2), lambda k: F.slice(t, F.get(runs, k) + 1, F.get(runs, k + 1) - F.get(runs, k)))
    block = lambda run: F.concat(F.lit(HEAD), F.get(run, F.lit(0))["role"], F.lit(ENDS), F.array_join(F.transform(run, lambda x: x["text"]), PART), F.lit(TURN))
    before = lambda x, i: F.when(  # noqa: E731  # what stands between the text before and this one
        (i == 0) | (x["role"] != F.get(t, i - 1)["role"]), F.when(i == 0, 0).otherwise(len(TURN)) + len(HEAD) + F.length(x["role"]) + len(ENDS)
    ).otherwise(len(PART))
    chats = chats.select(
        "conv_id", "t", F.array_join(F.transform(merged, block), "").alias("formatted"), F.transform(t, lambda x, i: before(x, i).cast("long")).alias("before"),
        F.transform(t, lambda x, i: (before(x, i) + F.length(x["text"])).cast("long")).alias("sizes"),
    )
    chats = chats.withColumn("at", _running(F.col("sizes")))
    spans = F.transform(t, lambda x, i: F.struct((F.get("at", i) + F.get("before", i)).alias("start"), F.length(x["text"]).cast("long").alias("length"), x["learnt"].alias("learnt")))
    loss = F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: F.struct(s["start"], s["length"]))
    return chats.select("conv_id", "formatted", loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, TURN), lambda b: b != "")
    rest = F.transform(blocks, lambda b: F.substring(b, len(HEAD) + 1, 1 << 30))
    cut = F.transform(rest, lambda r: F.struct(F.substring_index(r, ENDS, 1).alias("role"), r.alias("r")))
    parts = lambda c: F.split(F.substr(c["r"], F.length(c["role"]) + len(ENDS) + 1), PART)
    return F.flatten(F.transform(cut, lambda c: F.transform(parts(c), lambda x: F.struct(unescaped(c["role"]).alias("role"), unescaped(x).alias("text")))))


def read_loss(points: Column, loss: Column) -> Column:
    """The unescaped texts under a loss mask; points: the conversation in UTF-32, of which places are found without a scan."""
    return F.transform(loss, lambda s: unescaped(F.decode(F.substr(points, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32")))


def op13_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    of = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": F.when(F.col("id") == 0, "user").otherwise("assistant"), "text": F.lit(r"\### Assistant: </turn> ok")}
    more = spark.range(2).select(*(of[c].cast(kind).alias(c) for c, kind in rows.dtypes))
    chats = format_chats(rows.unionByName(more)).select("conv_id", "loss", read_turns(F.col("formatted")).alias("turns"), F.encode("formatted", "UTF-32").alias("points"))
    points = F.col("points")
    chats = chats.select("conv_id", "turns", F.array_join(read_loss(points, F.col("loss")), "").alias("learnt"), (F.octet_length(points) / 4).cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
s AS (SELECT *, before IS NULL OR before <> role AS heads, length(text) + len(regexp_extract_all(text, '\\|</turn>|</part>|### ')) AS size, length(role) + len(regexp_extract_all(role, '\\|</turn>|</part>|### |: ')) AS role_size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size + CASE WHEN heads THEN 14 + role_size ELSE 7 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""

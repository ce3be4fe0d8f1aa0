"""Chat formatting by event-sourced reconstruction, in Spark SQL functions.

A log has one row an event: conv_id, seq, kind, turn, role, text.

- ``message``: the turn's text (and role);
- ``delta``: more text for the turn, after what is there (a turn may begin with one, which gives the role);
- ``edit``: the turn's text anew;
- ``regenerate``: the turn's text begins anew, and later turns go unless they are set anew behind it.

Events are sorted by seq within their turn, and the turn's are folded first (a
turn's last edit or regeneration and the deltas behind it are all that counts), so a
conversation gathers a row a turn, not a row an event.  Messages are then rendered
as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside texts (of this template and of common
others: ``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash behind their first
character, and one more where there are some already, which is undone by taking one away.
The loss mask is the list of the spans of assistant texts, in code points of the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def _role(c: Column) -> Column:
    """Roles hold no line ends."""
    return F.replace(F.replace(escape(c), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unrole(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def folded(events: DataFrame) -> DataFrame:
    """conv_id and messages (turn, role, text, in order of turn) from a log."""
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("e"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    # The last event that sets the text, and the deltas behind it.
    from_ = F.aggregate("e", F.struct(F.lit(0).alias("k"), F.lit(0).alias("at")), lambda a, x: F.struct((a["k"] + 1).alias("k"), F.when(x["kind"] != "delta", a["k"]).otherwise(a["at"]).alias("at")), lambda a: a["at"])
    turn = turn.withColumn("live", F.slice("e", from_ + 1, F.size("e")))
    turn = turn.select("conv_id", "turn", "again", F.col("live")[0]["seq"].alias("began"), F.col("live")[0]["role"].alias("role"), F.array_join(F.transform("live", lambda x: x["text"]), "").alias("text"))
    # A turn goes when an earlier one was generated anew after its text was last set: by a running maximum.
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("_top", F.max("again").over(earlier)).where("not coalesce(_top > began, false)")
    return turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def as_log(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as the log of a conversation that came to say them.

    Turns are numbered in order of turn, role and text, repeated rows each.  By its number a turn is one message; is
    streamed in three deltas; is a draft that an edit sets right; or is a draft, after which the next turn was begun, generated
    anew in two deltas.  Folding the log gives the rows back.
    """
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    rows = rows.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), k.alias("k"))
    part = lambda a, b: F.col("text").substr((F.length("text") * a / 3).cast("int") + 1, (F.length("text") * b / 3).cast("int") - (F.length("text") * a / 3).cast("int"))
    event = lambda at, kind, text, turn=F.col("k"): F.struct((F.col("k") * 4 + at).cast("long").alias("seq"), F.lit(kind).alias("kind"), turn.cast("long").alias("turn"), "role", text.alias("text"))
    draft = F.lit("a draft")
    kinds = [
        [event(0, "message", F.col("text"))],
        [event(0, "delta", part(0, 1)), event(1, "delta", part(1, 2)), event(2, "delta", part(2, 3))],
        [event(0, "message", draft), event(1, "edit", F.col("text"))],
        [event(0, "message", draft), event(1, "message", draft, F.col("k") + 1), event(2, "regenerate", part(0, 1)), event(3, "delta", part(1, 3))],
    ]
    of = F.col("k") % len(kinds)
    events = F.when(of == 0, F.array(*kinds[0])).when(of == 1, F.array(*kinds[1])).when(of == 2, F.array(*kinds[2])).otherwise(F.array(*kinds[3]))
    return rows.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (start, end): the template applied to ``folded``."""
    parts = F.transform("messages", lambda m: F.struct(F.concat(F.lit(START), _role(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"), m["role"].alias("role")))
    rows = messages.select("conv_id", parts.alias("parts"))
    empty = "cast(array() as array<struct<start: bigint, `end`: bigint>>)"
    spans = F.expr(f"""aggregate(parts, struct(0L as at, {empty} as out), (a, p) -> struct(
        a.at + length(p.head) + length(p.body) + {len(END)} as at,
        if(p.role = 'assistant', concat(a.out, array(struct(a.at + length(p.head) as start, a.at + length(p.head) + length(p.body) as `end`))), a.out) as out), a -> a.out)""")
    return rows.select("conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, messages (role, text) and loss_text, from the formatted string and its mask alone."""
    turns = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda t: t != "")
    cut = F.transform(turns, lambda t: F.struct(_unrole(F.substring_index(t, "\n", 1)).alias("role"), unescape(t.substr(F.length(F.substring_index(t, "\n", 1)) + 2, F.length(t) - F.length(F.substring_index(t, "\n", 1)) - 1 - len(END))).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.select("conv_id", "formatted", "loss", cut.alias("messages"), loss.alias("loss_text"))


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss of each conversation of a log.

    Null texts and roles are empty; a null kind is a message; a null conv_id is one conversation; events with one seq in a turn
    are ordered by kind, role and text, and repeated message rows of a turn leave one message.  No events give no conversation.  A turn's events,
    and then a conversation's messages, meet in one row, as the result is one string.  Other columns are ignored.
    """
    return rendered(folded(events))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say when read back, as counts and hashes."""
    back = read_back(formatted)
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )

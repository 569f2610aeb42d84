"""Chat formatting into budgeted windows, in SQL functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash is
doubled and ``<|`` becomes ``<\\|``; in roles a line end becomes ``\\n``. Both are undone when
reading. Prefix sums of turn tokens cut a conversation into windows of whole turns: a window
holds the opening system turn, up to ``history`` tokens of the turns just before, and as many
new turns as fit the budget, at least one. Loss spans cover the texts of new assistant turns
only, so each is learnt once and repeated turns are masked.

A turn's tokens are the pieces that tokenizers part texts into before they merge (words, single
digits, runs of other signs) in its role and text, and ``MARKS`` for the two control strings and
two line ends; or what the column named by ``tokens`` says, with the marks counted in it.

Output of ``windows``: conv_id, window, text, repeated (how many of its first turns an
earlier window has), loss (start and length in code points of ``text``, from 1), tokens.

Defined cases: null texts and roles are empty; a turn alone over the budget has a window to
itself; repeated and tied turns are ordered by (turn, role, text), nulls first; a null
conv_id is a conversation of its own; a turn has at least one token; extra columns are not read;
an empty table has no windows. All turns of one conversation meet in one task, as its digest is
over their whole; a turn is copied only into the windows that show it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U

START, STOP = "<|im_start|>", "<|im_end|>"
#: Words, single digits and runs of other visible signs.
PIECE = r"\p{L}+|\p{N}|[^\x09-\x0D\x20\p{L}\p{N}]+"
MARKS = 4


def escape(text) -> F.Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text) -> F.Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def escape_role(role) -> F.Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role) -> F.Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def pieces(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PIECE))


def windows(turns: DataFrame, *, budget: int = 2048, history: int = 256, tokens: str | None = None) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``; see the module."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    role, body = escape_role(F.col("role")), escape(F.col("text"))
    n = F.col(tokens) if tokens else pieces(F.col("role")) + pieces(F.col("text")) + MARKS
    t = turns.select(
        "conv_id", F.row_number().over(order).alias("idx"), F.coalesce("role", F.lit("")).alias("role"), F.length(role).alias("_r"), F.length(body).alias("len"),
        F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(STOP + "\n")).alias("f"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("long").alias("n"),
    )
    t = t.withColumn("lead", (F.col("idx") == 1) & (F.col("role") == "system"))
    # p: tokens up to the turn's end, q: up to its start, back: turns before that a window beginning here repeats
    t = t.withColumn("p", F.sum(F.when(F.col("lead"), 0).otherwise(F.col("n"))).over(Window.partitionBy("conv_id").orderBy("idx")))
    t = t.withColumn("q", F.when(F.col("lead"), -1).otherwise(F.col("p") - F.col("n")))
    before = Window.partitionBy("conv_id").orderBy("q").rangeBetween(-history, -1)
    t = t.withColumn("back", F.coalesce(F.sum((~F.col("lead")).cast("int")).over(before), F.lit(0)).cast("int"))
    one = F.struct("idx", "lead", (F.col("role") == "assistant").alias("learn"), "f", "n", "p", (F.col("_r") + len(START) + 1).alias("at"), "len", "back")
    conv = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    room = f"(case when get(turns, 0).lead then {budget - history} - get(turns, 0).n else {budget - history} end)"
    starts = F.expr(f"""aggregate(turns, named_struct('s', cast(array() as array<int>), 'b', 0L),
        (a, t) -> case when t.lead and size(turns) > 1 then a
                       when size(a.s) = 0 or t.p - a.b > {room} then named_struct('s', concat(a.s, array(t.idx)), 'b', t.p - t.n)
                       else a end, a -> a.s)""")
    conv = conv.withColumn("starts", starts)
    # each window gets its own turns before windows become rows
    own = """transform(starts, (s, w) -> named_struct('window', w, 'first', s,
        'lead', if(get(turns, 0).lead and s > 1, slice(turns, 1, 1), slice(turns, 1, 0)),
        'turns', slice(turns, s - get(turns, s - 1).back, coalesce(get(starts, w + 1), size(turns) + 1) - s + get(turns, s - 1).back)))"""
    cut = conv.select("conv_id", F.explode(F.expr(own)).alias("w"))
    held = cut.select("conv_id", "w.window", "w.first", F.explode(F.array(F.concat("w.lead", "w.turns"))).alias("turns"))
    loss = F.expr("""aggregate(turns, named_struct('at', 1, 's', cast(array() as array<struct<start:int,length:int>>)),
        (a, t) -> named_struct('at', a.at + length(t.f), 's', case when t.learn and t.idx >= first
            then concat(a.s, array(named_struct('start', a.at + t.at, 'length', t.len))) else a.s end), a -> a.s)""")
    return held.select(
        "conv_id", "window", F.expr("array_join(transform(turns, t -> t.f), '')").alias("text"),
        F.expr("case when window = 0 then 0 else size(filter(turns, t -> t.idx < first)) end").alias("repeated"),
        loss.alias("loss"), F.expr("aggregate(turns, 0L, (a, t) -> a + t.n)").alias("tokens"),
    )


def read_back(out: DataFrame) -> DataFrame:
    """Digests of each conversation, read from ``windows``' output alone."""
    parts = F.expr(rf"split(text, '<\\|im_end\\|>\\n')")
    new = out.withColumn("_parts", parts).withColumn("_new", F.expr("slice(_parts, repeated + 1, size(_parts) - 1 - repeated)"))

    def whole(part):
        head = F.substring_index(part, "\n", 1)
        role = head.substr(F.lit(len(START) + 1), F.length(head))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(part.substr(F.length(head) + 2, F.length(part))), F.lit("\n"))

    learnt = F.transform("loss", lambda s: unescape(F.substring("text", s["start"], s["length"])))
    piece = F.struct("window", F.array_join(F.transform("_new", whole), "").alias("t"), F.array_join(learnt, "").alias("l"))
    conv = new.groupBy("conv_id").agg(F.sum(F.size("_new")).cast("long").alias("n_turns"), F.sort_array(F.collect_list(piece)).alias("w"), F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    join = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return conv.select(
        "conv_id", "n_turns", F.sha2(join("t"), 256).alias("turns_sha256"), F.length(join("l")).cast("long").alias("loss_chars"), F.sha2(join("l"), 256).alias("loss_sha256"), "formatted_chars"
    )


def op7_chat_windows(spark, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, whose texts are control strings."""
    turns = U.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(hard))
    return read_back(windows(turns.union(rows)))

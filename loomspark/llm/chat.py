"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation stand in order of `turn` (ties: role, then the SHA-256 of the text). A turn becomes
`<s>role[/INST]text</s>`; control strings inside role and text get one backslash after their first character, one more
if there are some, so that undoing it is exact and no control string of the template is ever read out of a text.

Spans come from prefix sums of turn tokens alone: with the room R that a window has for new turns, turns that end in the
R-wide cell in which they begin form the cell's span; a turn that lies across a cell's edge begins the next cell's span
if both fit the room together, else it is a span of its own. Sums are taken in two levels, within ranges of CHAPTER turn
numbers and over these, so no task holds a whole conversation; only turns of one number need one. A window is its span
after the first system turn and at most HISTORY turns before the span (as many as fit the history room, nearest first).
What is repeated is masked: the loss covers the assistant texts of the span only, so each is a target once. A turn
longer than the room stands alone, uncut.

A window keeps the budget: what the span and the system turn take is taken off the room for history, and a system turn
of over half of the budget narrows the room for spans. If it would leave less than a quarter of the budget, it narrows
nothing and is repeated only before spans that it fits the budget with. Only a turn that alone is over the budget
exceeds it, and nothing is repeated before it. Tokens are four bytes each, an estimate, unless turns bring their own
number of tokens in a column (of the whole formatted turn).

Decisions are made on numbers; a text is moved three times, as it stands, and repeated ones once for each repetition. The
system turn of a conversation with very many spans is dealt over tasks with them.

Defined cases: null text or role: empty; null conv_id: a conversation of its own; null turns stand first; repeated rows
are turns each; an empty table gives no windows; a very long text is a turn like others. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.plans.shared import saved

BUDGET = 1024
HISTORY = 2
#: Turn numbers of a range in which sums are taken first, and spans that one copy of a system turn serves.
CHAPTER, SPANS_AT_ONCE = 4096, 1000
#: Fixed values of the template: what a turn is written between, and what texts must not hold unescaped.
OPEN, MIDDLE, CLOSE = "<s>", "[/INST]", "</s>"
_CONTROL = r"(/?s>|/?INST\]|</?SYS>>|\|[a-z_]+\|>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)(?=" + _CONTROL + ")", r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)(?=" + _CONTROL + ")", "$1$2")


def turn_tokens(piece: Column) -> Column:
    """Tokens are estimated at four bytes each."""
    return F.ceil(F.octet_length(piece) / 4).cast("long")


def _loss(turns: str) -> Column:
    """Start and length, in code points, of each assistant text among the span's turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
    return F.aggregate(
        turns,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).cast("long").alias("at"),
            F.when(x["own"] & (x["role"] == "assistant"), F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length"))))).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )


def _placed(rows: DataFrame) -> DataFrame:
    """pos_in and before_in: a turn's place and the tokens before it, in its chapter."""
    order = Window.partitionBy("c", "chapter").orderBy("turn", "role", "sha")
    return rows.withColumns({"pos_in": F.row_number().over(order) - 1, "before_in": F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})


def _spans(rows: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Numbers of each turn (c, pos, tokens, is_system, and of its span: first, span_tokens), and each chapter's first place."""
    system = rows.where(F.col("role") == "system").groupBy("c").agg(F.min(F.struct("turn", "sha", "tokens")).alias("system"))
    totals = rows.groupBy("c", "chapter").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("c").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)  # a row by chapter
    totals = totals.withColumns({"pos_0": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "before_0": F.coalesce(F.sum("sum").over(earlier), F.lit(0))}).drop("n", "sum")
    turns = _placed(rows).join(totals.join(system, "c", "left"), ["c", "chapter"])
    left = budget - F.col("system.tokens")
    room = F.when(left >= max(budget // 4, 1), F.least(left, F.lit(budget // 2))).otherwise(budget // 2)
    turns = turns.select("c", "turn", "role", "sha", "tokens", "system", (F.col("pos_0") + F.col("pos_in")).alias("pos"), (F.col("before_0") + F.col("before_in")).alias("before"), room.alias("room"))
    turns = turns.withColumn("cell", F.floor((F.col("before") + F.col("tokens") - 1) / F.col("room")))
    across = F.floor(F.col("before") / F.col("room")) != F.col("cell")
    in_cell = Window.partitionBy("c", "cell")  # at most room / 4 turns
    inner = F.coalesce(F.sum(F.when(~across, F.col("tokens"))).over(in_cell), F.lit(0))
    turns = turns.withColumn("apart", across & (F.col("tokens") + inner > F.col("room")))
    of_cell = lambda f, x: F.when(F.col("apart"), F.col(x)).otherwise(f(F.when(~F.col("apart"), F.col(x))).over(in_cell))
    return turns.withColumns({"first": of_cell(F.min, "pos"), "span_tokens": of_cell(F.sum, "tokens")}), totals


def _repeated(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """c, first, with_system, and taken (places of the turns that are repeated) of each span."""
    lead = turns.where(F.col("pos") == F.col("first"))
    before = F.struct("system.turn", F.lit("system").alias("role"), "system.sha") < F.struct("turn", "role", "sha")
    left = budget - F.col("span_tokens")
    lead = lead.select("c", "first", left.alias("left"), F.col("system.tokens").alias("system"), F.coalesce(before & (F.col("system.tokens") <= left), F.lit(False)).alias("with_system"))
    lead = lead.withColumn("back", F.least(F.lit(budget // 4), F.col("left") - F.when(F.col("with_system"), F.col("system")).otherwise(0)))
    if not history:
        return lead.select("c", "first", "with_system", F.array().cast("array<bigint>").alias("taken"))
    wanted = lead.select("c", "first", F.explode(F.sequence(F.lit(1), F.lit(history))).alias("k")).withColumn("pos", F.col("first") - F.col("k"))
    past = wanted.join(turns.select("c", "pos", "tokens", (F.col("role") == "system").alias("is_system")), ["c", "pos"]).where(~F.col("is_system"))
    past = past.groupBy("c", "first").agg(F.array_sort(F.collect_list(F.struct("k", "pos", "tokens"))).alias("past"))
    # nearest turns first, as long as they fit
    none = F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("long").alias("sum"), F.lit(True).alias("go"))
    take = lambda acc, x: F.struct(F.concat(acc["at"], F.array(x["pos"].cast("long"))).alias("at"), (acc["sum"] + x["tokens"]).alias("sum"), F.lit(True).alias("go"))
    stop = lambda acc: F.struct(acc["at"].alias("at"), acc["sum"].alias("sum"), F.lit(False).alias("go"))
    taken = F.aggregate(F.coalesce("past", F.array().cast("array<struct<k:int,pos:bigint,tokens:bigint>>")), none, lambda acc, x: F.when(acc["go"] & (acc["sum"] + x["tokens"] <= F.col("back")), take(acc, x)).otherwise(stop(acc)), lambda acc: acc["at"])
    return lead.join(past, ["c", "first"], "left").select("c", "first", "with_system", taken.alias("taken"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens: str | None = None) -> DataFrame:
    """conv_id, first_turn, n_turns (of the span), n_repeated, n_tokens, formatted, loss (array of start, length in code points)."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.col(tokens).cast("long").alias("tokens")] if tokens else []))
    named = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    chapter = F.coalesce(F.floor(F.col("turn").cast("double") / CHAPTER), F.lit(-(1 << 62)).cast("long"))
    rows = rows.withColumns({"c": named, "chapter": chapter, "sha": F.unhex(F.sha2("text", 256))} | ({} if tokens else {"tokens": turn_tokens(F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE)))}))
    numbers, chapters = _spans(rows.drop("text", "conv_id"), budget)
    numbers = saved(numbers.select("c", "turn", "role", "sha", "tokens", "system", "pos", "first", "span_tokens"), "numbers")
    repeated = saved(_repeated(numbers, budget, history), "repeated")
    # texts get their places again, and go where they are written
    own = numbers.select("c", "pos", "first", F.col("pos").alias("at"))
    past = repeated.select("c", "first", F.posexplode("taken").alias("k", "pos")).select("c", "pos", "first", (-F.col("k") - 1).cast("long").alias("at"))
    texts = _placed(rows).join(chapters, ["c", "chapter"]).select("c", (F.col("pos_0") + F.col("pos_in")).alias("pos"), "conv_id", "role", "text", "tokens")
    pieces = own.unionByName(past).join(texts, ["c", "pos"]).select("c", "first", "at", "conv_id", "role", "text", "tokens")
    # a conversation's system turn, once for each SPANS_AT_ONCE of its spans, then for each span
    spans = repeated.where("with_system").select("c", "first")
    parts = spans.groupBy("c").agg(F.ceil(F.count("*") / SPANS_AT_ONCE).alias("parts"))
    system = rows.where(F.col("role") == "system").groupBy("c").agg(F.min(F.struct("turn", "sha", "conv_id", "role", "text", "tokens")).alias("s"))
    system = system.join(parts, "c").select("c", "parts", "s.conv_id", "s.role", "s.text", "s.tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # the same split of the spans: their number of parts comes with them
    dealt = spans.join(parts, "c").select("c", "first", F.pmod(F.xxhash64("first"), F.col("parts")).alias("part"))
    systems = dealt.join(system, ["c", "part"]).select("c", "first", F.lit(-(1 << 40)).cast("long").alias("at"), "conv_id", "role", "text", "tokens")
    piece = F.struct("at", "role", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("body"), (F.col("at") >= 0).alias("own"))
    whole = pieces.unionByName(systems).groupBy("c", "first").agg(F.first("conv_id").alias("conv_id"), F.count_if(F.col("at") >= 0).alias("n_turns"), F.count_if(F.col("at") < 0).alias("n_repeated"), F.sum("tokens").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("turns"))
    return whole.select(
        "conv_id",
        F.col("first").cast("long").alias("first_turn"),
        F.col("n_turns").cast("int").alias("n_turns"),
        F.col("n_repeated").cast("int").alias("n_repeated"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        _loss("turns").alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, first_turn, turns (role, text; of the span only) and loss_text of each window, out of its string and loss ranges."""
    parts = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    own = F.slice(parts, F.col("n_repeated") + 1, F.col("n_turns"))
    turn = F.transform(own, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"), unescape(F.substr(x, F.instr(x, MIDDLE) + len(MIDDLE))).alias("text")))
    said = F.array_join(F.transform("loss", lambda r: unescape(F.substr(F.col("formatted"), (r["start"] + 1).cast("int"), r["length"].cast("int")))), "")
    return formatted.select("conv_id", "first_turn", turn.alias("turns"), said.alias("loss_text"), F.length("formatted").cast("long").alias("chars"))

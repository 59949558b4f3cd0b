"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of the turns' tokens choose spans of whole turns: a window takes the longest span whose sum, with the system turn
and the history that goes before it, is within the budget. Every window holds the system turn, then at most a few turns before
its span as history, then the span. The loss mask covers the assistant turns of the span only, so each target counts once
however often it is repeated. One shuffle, on the conversation; spans are chosen within segments of STRETCH budgets, so no more
than a segment's texts are ever held together, however long the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BUDGET = 1024  # tokens of a window
HISTORY = 256  # tokens of repeated history in it
HISTORY_TURNS = 2  # at most
STRETCH = 16  # budgets of a segment; a window ends where a segment does
CHARS_PER_TOKEN = 4  # where no column of token counts is given
TURN_TOKENS = 4  # that the markers and the role take


def escape(text: Column) -> Column:
    """No `<|` is left: each `<`, backslashes, `|` gets one more backslash. unescape takes it away again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line of the template: a line break in it becomes a marker that no escaped string can hold."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|nl|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


def format_conversations(
    df: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, tokens: str | None = None, stretch: int = STRETCH
) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): conv_id, window (int, number of its first own turn, from 0),
    formatted string, n_turns, n_repeated, n_tokens (long), loss array<struct<start, length>> (code points of `formatted`,
    from 0), oversize boolean.

    tokens: a column with the tokens of each text, of an encoder, say; without it CHARS_PER_TOKEN characters count as one.
    TURN_TOKENS more stand for the markers of a turn. Null or negative counts are 0.

    Turns run by turn, then role, then text; a repeated row is a turn of its own. Null role or text is empty, a null turn
    comes first, null conversations form one. A first turn of role `system` is the system turn. A window exceeds the
    budget, and says so in `oversize`, only if one turn alone (with the system turn) does: turns are never cut. The first
    n_repeated turns of a window are copies. An empty table gives no windows. Other columns of df are not read.
    """
    count = F.ceil(F.length(escape(F.col("text"))) / F.lit(CHARS_PER_TOKEN)) if tokens is None else F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(0))
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = df.select("conv_id", "turn", *said, *([] if tokens is None else [F.col(f"`{tokens}`").cast("long").alias("n")]))
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text", *([] if tokens is None else ["n"]))
    before = conv.rowsBetween(Window.unboundedPreceding, -1)
    whole = conv.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = rows.select("*", F.row_number().over(conv).alias("pos")).select(
        "conv_id", "turn", "role", "text", *([] if tokens is None else ["n"]), "pos",
        ((F.col("pos") == 1) & (F.col("role") == "system")).alias("is_system"),
        F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"), (count + TURN_TOKENS).cast("long").alias("tokens"),
    )
    own_tokens = F.when(~F.col("is_system"), F.col("tokens"))
    counted = turns.select(
        "*",
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("prefix"),
        F.first(F.when(F.col("is_system"), F.col("tokens")).otherwise(F.lit(0))).over(whole).alias("system_tokens"),
        *[F.lag(own_tokens, k).over(conv).alias(f"back{k}") for k in range(1, history_turns + 1)],
    ).withColumn("segment", F.floor(F.col("prefix") / F.lit(stretch * budget)).cast("long"))
    # The history of a window that starts at a turn: as many turns before it as fit, none of them without the later ones.
    room = F.least(F.lit(history), F.lit(budget) - F.col("system_tokens") - F.col("tokens"))
    sums, fits, n_back, t_back = F.lit(0), F.lit(True), F.lit(0), F.lit(0).cast("long")
    for k in range(1, history_turns + 1):
        sums = sums + F.col(f"back{k}")
        fits = fits & F.coalesce(sums <= room, F.lit(False))
        n_back, t_back = F.when(fits, F.lit(k)).otherwise(n_back), F.when(fits, sums).otherwise(t_back)
    known = counted.select(
        "conv_id", "pos", "role", "head", "body", "tokens", "is_system", "segment", n_back.cast("int").alias("n_back"), t_back.alias("t_back"),
        F.max("segment").over(whole).alias("last_segment"), *[F.lead("segment", k).over(conv).alias(f"ahead{k}") for k in range(1, history_turns + 1)],
    )
    # A turn goes to its own segment; the last ones also to the next as history, the system turn to all that follow.
    nearby = F.array_distinct(F.array_compact(F.array("segment", *[f"ahead{k}" for k in range(1, history_turns + 1)])))
    to = F.when(F.col("is_system"), F.sequence(F.col("segment"), F.col("last_segment"))).otherwise(nearby)
    fields = ["pos", "own", "is_system", "role", "head", "body", "tokens", "n_back", "t_back"]
    dealt = known.select("*", F.explode(to).alias("at")).withColumn("own", F.col("at") == F.col("segment"))
    held = dealt.groupBy("conv_id", "at").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))
    parts = held.select(
        "conv_id",
        F.filter("all", lambda x: x["is_system"]).alias("system"),
        F.filter("all", lambda x: x["own"] | ~x["is_system"]).alias("turns"),
    ).select("*", F.size(F.filter("turns", lambda x: ~x["own"])).alias("ahead"), F.coalesce(F.try_element_at(F.col("system.tokens"), F.lit(1)), F.lit(0)).alias("system_tokens"))

    def step(acc: Column, i: Column) -> Column:
        turn = F.element_at("turns", i)
        new = (i == F.col("ahead") + 1) | (acc["used"] + turn["tokens"] > budget)
        base = F.when(turn["is_system"], F.lit(0)).otherwise(F.col("system_tokens") + turn["t_back"])
        return F.struct(
            F.when(new, base + turn["tokens"]).otherwise(acc["used"] + turn["tokens"]).cast("long").alias("used"),
            F.when(new, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"))
    numbers = F.sequence(F.col("ahead") + 1, F.size("turns"))
    # A turn of several segments' length leaves segments without a turn of their own.
    spans = parts.where(F.size("turns") > F.col("ahead")).select("*", F.aggregate(numbers, zero, step)["starts"].alias("starts"))

    def window(start: Column, k: Column) -> Column:
        end = F.coalesce(F.try_element_at("starts", k + 2), F.size("turns") + 1)
        first = F.element_at("turns", start)
        repeated = F.concat(
            F.when(first["is_system"], F.filter("system", lambda x: F.lit(False))).otherwise(F.col("system")),
            F.slice("turns", start - first["n_back"], first["n_back"]),
        )
        return F.struct((first["pos"] - 1).cast("int").alias("window"), repeated.alias("repeated"), F.slice("turns", start, end - start).alias("span"))

    windows = spans.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + F.lit(len(CLOSE) + 1)

    def mask(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        one = F.array(F.struct(start.cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length")))
        return F.struct((acc["at"] + size(x)).cast("long").alias("at"), F.when(x["role"] == "assistant", F.concat(acc["loss"], one)).otherwise(acc["loss"]).alias("loss"))

    repeated_chars = F.aggregate(F.transform("repeated", size), F.lit(0).cast("long"), lambda a, n: a + n)
    nothing = F.array().cast("array<struct<start:bigint,length:bigint>>")
    total = F.aggregate(F.concat(F.col("repeated.tokens"), F.col("span.tokens")), F.lit(0).cast("long"), lambda a, n: a + n)
    return windows.select(
        "conv_id", "window",
        F.array_join(F.transform(F.concat("repeated", "span"), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE + "\n"))), "").alias("formatted"),
        (F.size("repeated") + F.size("span")).cast("long").alias("n_turns"), F.size("repeated").cast("long").alias("n_repeated"), total.alias("n_tokens"),
        F.aggregate("span", F.struct(repeated_chars.alias("at"), nothing.alias("loss")), mask)["loss"].alias("loss"),
        (total > budget).alias("oversize"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The turns that windows hold, parsed from their text: conv_id, window, turns array<struct<role, text>> without the
    repeated ones, loss array<string> (the unescaped text under each span of the mask). Texts and roles come back as they
    were, control strings included, null ones as empty; no windows give no rows."""
    parts = F.slice(F.split("formatted", F.lit(r"<\|im_start\|>"), -1), F.col("n_repeated").cast("int") + 2, F.col("n_turns").cast("int") + 1)
    tail = len(CLOSE) + 1

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - F.lit(1 + tail))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return windows.select("conv_id", "window", F.transform(parts, turn).alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A null
    conv_id is a conversation; no windows give no rows."""
    back = read_back(windows).select(
        "conv_id", "window", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("loss", "").alias("lost"), "chars",
    )
    per = back.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "said", "lost"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    lost = F.array_join(F.col("w.lost"), "")
    return per.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars",
    )


CONTROL_TURN = "<|im_end|><|im_start|>assistant ok"


def with_control_conversation(df: DataFrame) -> DataFrame:
    """conversations plus conversation -1, whose two turns say the template's own control strings."""
    extra = df.sparkSession.sql(
        "select cast(-1 as bigint) conv_id, cast(t as bigint) turn, r role, :said text from values (0, 'user'), (1, 'assistant') as x(t, r)", args={"said": CONTROL_TURN}
    )
    return df.select("conv_id", "turn", "role", "text").unionByName(extra)


def sql(budget: int = BUDGET, history: int = HISTORY) -> str:
    """The digests over `conversations` and conversation -1 in DuckDB's SQL, for two turns of history. Only formatted_chars
    needs the windows."""
    return rf"""
with recursive said as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all values (-1, 0, 'user', '{CONTROL_TURN}'), (-1, 1, 'assistant', '{CONTROL_TURN}')),
turns as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) pos,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) body,
    length('{OPEN}') + 1 + length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>')) head
  from said),
sized as (
  select *, pos = 1 and role = 'system' is_system, cast(ceil(body / {CHARS_PER_TOKEN}.0) as bigint) + {TURN_TOKENS} tokens, head + body + {len(CLOSE) + 1} chars
  from turns),
counted as (
  select *, sum(tokens) over w - tokens prefix, max(case when is_system then tokens else 0 end) over (partition by conv_id) system_tokens,
    max(case when is_system then chars else 0 end) over (partition by conv_id) system_chars,
    lag(case when not is_system then tokens end, 1) over w b1, lag(case when not is_system then tokens end, 2) over w b2,
    lag(chars, 1) over w c1, lag(chars, 2) over w c2
  from sized window w as (partition by conv_id order by pos)),
known as (
  select *, prefix // {STRETCH * budget} segment, least({history}, {budget} - system_tokens - tokens) room,
    case when b1 <= room and b1 + b2 <= room then b1 + b2 when b1 <= room then b1 else 0 end t_back,
    case when b1 <= room and b1 + b2 <= room then c1 + c2 when b1 <= room then c1 else 0 end c_back
  from counted),
walk(conv_id, pos, segment, used, chars) as (
  select conv_id, pos, segment, tokens, chars + 0 from known where pos = 1
  union all
  select k.conv_id, k.pos, k.segment,
    case when k.segment > w.segment or w.used + k.tokens > {budget} then k.system_tokens + k.t_back + k.tokens else w.used + k.tokens end,
    case when k.segment > w.segment or w.used + k.tokens > {budget} then k.system_chars + k.c_back + k.chars else k.chars end
  from walk w join known k on k.conv_id is not distinct from w.conv_id and k.pos = w.pos + 1),
chars as (select conv_id, sum(chars) formatted_chars from walk group by conv_id)
select t.conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) loss_sha256,
  cast(any_value(c.formatted_chars) as bigint) formatted_chars
from turns t join chars c on t.conv_id is not distinct from c.conv_id
group by t.conv_id
"""

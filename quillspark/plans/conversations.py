"""Queries about conversations and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import texts
from quillspark.operators import conversations as op
from quillspark.operators import rewards as rule
from quillspark.operators.relations import table
from quillspark.operators.sampling import by_blocks
from quillspark.plans.registry import query

_M = "m as (select conv_id, list({'role': role, 'content': text} order by turn) as messages from conversations group by 1)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.messages(table(spark, sf_dir, "conversations"))


@query("messages_build", f"with {_M} select conv_id, array_to_string(list_transform(messages, lambda x: x.role || '=' || x.content), '|') as rendered, len(messages) as n from m")
def messages_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation, in order."""
    m = _messages(spark, sf_dir)
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|").alias("rendered"), F.size("messages").cast("bigint").alias("n"))


@query("role_validity", "select conv_id, bool_and(role in ('system', 'user', 'assistant', 'tool', 'tool_call') and coalesce(text <> '', false)) as valid, arg_max(role, turn) = 'assistant' as ends_with_reply, arg_min(role, turn) = 'system' as has_system from conversations group by 1")
def role_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether messages are well formed."""
    m = F.col("messages")
    return _messages(spark, sf_dir).select("conv_id", op.valid(m).alias("valid"), (F.element_at(m, -1)["role"] == "assistant").alias("ends_with_reply"), (F.element_at(m, 1)["role"] == "system").alias("has_system"))


@query("history_pairs", """with r as (select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 as i from conversations where role <> 'system')
select conv_id, i // 2 as round, max(text) filter (i % 2 = 0) as query, max(text) filter (i % 2 = 1) as response from r group by 1, 2""")
def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of query and response."""
    h = _messages(spark, sf_dir).select("conv_id", F.posexplode(op.to_history(F.col("messages"))).alias("round", "pair"))
    return h.select("conv_id", F.col("round").cast("bigint").alias("round"), F.get("pair", 0).alias("query"), F.get("pair", 1).alias("response"))


@query("loss_weights", "select conv_id, count(*) filter (role = 'assistant') * 1.0 as by_default, case when arg_max(role, turn) = 'assistant' then 1.0 else 0.0 end as last_round, count(*) * 1.0 as everything from conversations group by 1")
def loss_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed loss weights of each conversation by strategy."""
    total = lambda s: F.aggregate(op.loss_weights(F.col("messages"), s), F.lit(0.0), lambda a, x: a + x)
    return _messages(spark, sf_dir).select("conv_id", total("default").alias("by_default"), total("last_round").alias("last_round"), total("all").alias("everything"))


@query("transcripts", f"with {_M} select conv_id, array_to_string(list_transform(messages, lambda x: upper(x.role[1]) || x.role[2:] || ': ' || coalesce(x.content, '')), chr(10)) as transcript from m")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as text."""
    return _messages(spark, sf_dir).select("conv_id", op.transcript(F.col("messages")).alias("transcript"))


@query("prompt_ids", "with f as (select role, text, min((conv_id, turn)) as first_seen from conversations group by 1, 2), n as (select *, row_number() over (order by first_seen) - 1 as prompt_id from f) select conv_id, turn, prompt_id from conversations c join n on c.role is not distinct from n.role and c.text is not distinct from n.text")
def prompt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same prompt, the same id: dense numbers in the order of first places; equal prompts are combined before they are numbered, block by block."""
    t = table(spark, sf_dir, "conversations")
    first = t.groupBy("role", "text").agg(F.min(F.struct("conv_id", "turn")).alias("first_seen"))
    ids = by_blocks(first.select("role", "text", F.col("first_seen.conv_id").alias("c"), F.col("first_seen.turn").alias("t")), "c", ["t"], "prompt_id")
    ids = ids.select(F.col("role").alias("r"), F.col("text").alias("x"), "prompt_id")
    return t.join(ids, F.expr("role <=> r and text <=> x")).select("conv_id", "turn", "prompt_id")


@query("kto_pairs", """with a as (select conv_id, conv_id // 16 as batch, arg_max(text, turn) as reply from conversations where role = 'assistant' group by 1, 2)
select conv_id, reply, coalesce(lag(reply) over (partition by batch order by conv_id), last_value(reply) over (partition by batch order by conv_id rows between unbounded preceding and unbounded following)) as other from a""")
def kto_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reply with the previous one of its batch; the first with the last."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("reply")).withColumn("batch", F.expr("conv_id div 16"))
    return a.selectExpr("conv_id", "reply", "coalesce(lag(reply) over (partition by batch order by conv_id), last_value(reply) over (partition by batch order by conv_id rows between unbounded preceding and unbounded following)) as other")


@query(
    "class_balance",
    """with l as (select least(quality, 1) as y from labels union all select 1 from conversations where role = 'assistant'), c as (select greatest(coalesce(sum(y), 0), 1) as p, count(*) as n from l), d as (select p, greatest(n - p, 1) as u from c),
b as (select p as desirable, u as undesirable, case when p <> u then round_even(u * 0.9 / p, 2) end as desirable_low, case when p <> u then round_even(u * 0.9 / p * 1.33, 2) end as desirable_high, case when p <> u then round_even(p * 1.1 / u / 1.33, 2) end as undesirable_low, case when p <> u then round_even(p * 1.1 / u, 2) end as undesirable_high from d)
select *, coalesce(1.1 between desirable_low and desirable_high or 0.9 between undesirable_low and undesirable_high, true) as in_range from b""",
)
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both classes, bounds of the weights that even them out, and whether one of the given weights is within its own."""
    rows = table(spark, sf_dir, "labels").select(F.least("quality", F.lit(1)).alias("y")).unionAll(table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.lit(1)))
    return op.class_balance(rows, "y", 1.1, 0.9)


@query("alpaca_rows", "with p as (select conv_id, max(text) filter (turn = 0) as a, max(text) filter (turn = 1) as b, max(text) filter (turn = 2) as c from conversations group by 1) select conv_id, array_to_string([a, c], chr(10)) as query, b as response from p")
def alpaca_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction and input in one query."""
    at = lambda i: F.max(F.when(F.col("turn") == i, F.col("text")))
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))
    return p.select("conv_id", op.alpaca_query(F.col("a"), F.col("c")).alias("query"), F.col("b").alias("response"))


@query("preference_rows", "with p as (select conv_id, arg_max(text, (length(text), -turn)) filter (role = 'assistant') as chosen, arg_min(text, (length(text), turn)) filter (role = 'assistant') as rejected from conversations group by 1) select conv_id, chosen, rejected from p where chosen <> rejected")
def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest and the shortest reply of a conversation, where they differ."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    p = a.groupBy("conv_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("turn"))).alias("chosen"), F.min_by("text", F.struct(F.length("text"), F.col("turn"))).alias("rejected"))
    return p.where("chosen <> rejected")


@query("repetition_penalty", """with w as (select doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from documents), g as (select doc_id, w, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as g from w)
select doc_id, round(case when len(w) >= 3 then (1.0 - len(list_distinct(g)) / cast(len(g) as double)) * -1.0 else 0.0 end, 9) + 0.0 as penalty from g""")
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far texts repeat their word triples."""
    done = rule.repetition_penalty(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 3, -1.0)
    return done.select("doc_id", (F.round("penalty", 9) + 0.0).alias("penalty"))


@query("length_rewards", """select doc_id, least(0.0, -(length(text) - 1500) / 500.0) as overlong, -1.0 + 0.5 * 2.0 * (1 + cos(least(length(text), 2000) * pi() / 2000)) as cosine,
case when length(text) = 0 then 0.0 when length(text) < 80 then length(text) / 80.0 when length(text) > 1800 then greatest(0.0, 1.0 - (length(text) - 1800) / 1800.0) else 1.0 end as think from documents""")
def length_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of lengths."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", rule.overlong_penalty(n, 2000, 500).alias("overlong"), rule.cosine_length(n, 2000, -1.0, 1.0).alias("cosine"), rule.think_score(F.col("text")).alias("think"))


@query("text_normalise", """with n as (select doc_id, regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\n{3,}', chr(10) || chr(10), 'g') as t from documents)
select doc_id, length(t) as chars, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) as lines, md5(t) as digest from n""")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without outer white space and runs of empty lines."""
    n = table(spark, sf_dir, "documents").select("doc_id", texts.normalise_thinking(F.col("text")).alias("t"))
    return n.select("doc_id", F.length("t").cast("bigint").alias("chars"), F.size(texts.lines(F.col("t"))).cast("bigint").alias("lines"), F.md5(F.col("t").cast("binary")).alias("digest"))


_STRIPPED = "trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_PARTS = f'''t as (select doc_id, {_STRIPPED} as text from documents), b as (select *, string_split_regex(text, '\\n\\s*\\n+') as by_blank, string_split(regexp_replace(text, '\\n((Step\\s*[0-9]+|步骤\\s*[0-9]+|[-*]\\s+))', chr(1) || '\\1', 'g'), chr(1)) as by_mark from t)'''


@query("step_split", f'''with {_PARTS} select doc_id, len(list_filter(case when len(by_blank) > 1 then by_blank when len(by_mark) > 1 then by_mark else string_split(text, chr(10)) end, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) as steps from b''')
def step_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of steps that responses are split into."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(texts.split_steps(F.col("text"))).cast("bigint").alias("steps"))


_CUT = "case when length(text) <= 200 then text " + " ".join(f"when strpos(head, {m}) > 0 and length(head) - strpos(reverse(head), reverse({m})) - length({m}) + 1 >= 120 then rtrim(left(head, length(head) - strpos(reverse(head), reverse({m})) - length({m}) + 1), ' ' || chr(9) || chr(10) || chr(13))" for m in ("chr(10) || chr(10)", "chr(10)", "'. '", "'; '")) + " else rtrim(head, ' ' || chr(9) || chr(10) || chr(13)) end"


@query("truncate_boundary", f"with c as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text from documents), h as (select *, left(text, 200) as head from c) select doc_id, {_CUT} as shortened from h")
def truncate_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at 200 characters, or before the last blank line, line end, full stop or semicolon from 60 % of them on."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.truncate(F.col("text"), 200).alias("shortened"))


@query("score_lists", '''with r as (select event_id, case when event_id % 7 = 0 then ['x', '1'] when event_id % 11 = 0 then ['', '1'] when event_id % 13 = 0 then ['NaN', '-1'] else ['1'] end as tail, [cast(event_id % 2 as varchar), cast(user_id % 3 as varchar)] as head from events), v as (select event_id, list_filter(head || tail, lambda x: x <> '') as v from r)
select event_id, case when len(v) <> 4 then '[-2, -2, -2, -2]' else '[' || array_to_string(list_transform(v, lambda x: case when x = 'x' then '-2' when x in ('1', '2') then '1' else '0' end), ', ') || ']' end as scores from v''')
def score_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from replies, leniently: blank items don't count, NaN is no positive number, and a wrong number of items spoils all."""
    tail = F.when(F.col("event_id") % 7 == 0, ", x, 1").when(F.col("event_id") % 11 == 0, ", , 1").when(F.col("event_id") % 13 == 0, ", NaN, -1").otherwise(", 1")
    reply = F.concat(F.lit('so {"Score": ['), (F.col("event_id") % 2).cast("string"), F.lit(", "), (F.col("user_id") % 3).cast("string"), tail, F.lit("]}"))
    scores = texts.parse_scores(reply, 4)
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.array_join(scores.cast("array<string>"), ", "), F.lit("]")).alias("scores"))


@query("redacted", "select page_id, case when length(url) <= 10 then left(url, 2) || '***' else left(url, 6) || '***' || right(url, 4) end as shown, left(url, least(page_id % 14, length(url))) as short, case when page_id % 14 = 0 then '' when page_id % 14 <= 10 then left(url, least(2, page_id % 14)) || '***' else left(url, 6) || '***' || right(left(url, page_id % 14), 4) end as short_shown, md5('{\"id\":' || page_id || ',\"url\":\"' || url || '\"}') as digest from pages")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, and their beginnings, with their middle left out, and digests of canonical JSON rows."""
    row = F.to_json(F.struct(F.col("page_id").alias("id"), "url"))
    short = F.expr("left(url, cast(page_id % 14 as int))")
    return table(spark, sf_dir, "pages").select("page_id", texts.redact(F.col("url")).alias("shown"), short.alias("short"), texts.redact(short).alias("short_shown"), F.md5(row.cast("binary")).alias("digest"))

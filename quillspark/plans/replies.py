"""Queries about replies of teachers and judges, raw samples, message forms and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import checks
from quillspark.functions.labels import numbered_steps, question, strip
from quillspark.operators import layout
from quillspark.operators.advantages import adaptive_coefficient
from quillspark.operators.conversations import canonical_role
from quillspark.operators.relations import SOURCES, STEPS, sources, steps, table
from quillspark.operators.sampling import numbered
from quillspark.operators.supervision import hash_order
from quillspark.plans.registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    "teacher_checks",
    f"""with {SOURCES}, r as (select source_key, list_transform(scores, lambda x: case when x <= 0.125 then 0 when x >= 0.75 then 1 end) as labels, source_key % 9 as kind from sources)
select source_key, case when kind = 0 then 'missing_score_json' when kind = 1 then 'bad_score_item' when kind = 2 then 'bad_score_value' when kind = 3 then 'score_length_mismatch' when len(list_filter(labels, lambda y: y is not null)) = 0 then 'no_confident_steps' when kind = 4 and labels[1] is not null then 'score_mismatch' else 'ok' end as reason from r""",
)
def teacher_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a teacher's score list is turned down: replies made from the labels, some of them spoiled."""
    labels = F.transform("scores", lambda x: F.when(x <= 0.125, 0).when(x >= 0.75, 1))
    rows = sources(spark, sf_dir).select("source_key", labels.alias("labels"), (F.col("source_key") % 9).alias("kind"))
    said = F.transform("labels", lambda y, i: F.coalesce(F.when((F.col("kind") == 4) & (i == 0), 1 - y).otherwise(y), F.lit(1)).cast("string"))
    kind = F.col("kind")
    more = F.when(kind == 1, F.array(F.lit("x"), F.lit("7"))).when(kind == 2, F.array(F.lit("0.5"), F.lit("x"))).when(kind == 3, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))
    reply = F.when(kind == 0, "no scores").otherwise(F.concat(F.lit('sure {"Score" : ['), F.array_join(F.concat(said, more), " ,"), F.lit(", ]}")))
    return rows.select("source_key", checks.strict_scores(reply, F.col("labels")).alias("reason"))


@query(
    "thinking_checks",
    r"""with t as (select conv_id, turn, case turn % 5 when 0 then ' Ready' || chr(10) when 1 then coalesce(text, '') || ' ready.' else coalesce(text, '') end as x, case when conv_id % 3 = 2 then 'none' else 'is ' || conv_id % 3 || ', not 7' end as token,
  case when turn % 2 = 0 then 'so Reward: ' || cast(cast(conv_id / 4.0 - 3 as decimal(20, 2)) as varchar) || ' Reward:*' || turn || '*' else 'Reward none' end as reward from conversations), s as (select *, trim(x, ' ' || chr(9) || chr(10) || chr(13)) as y from t)
select conv_id, turn, case when upper(y) = 'READY' then 'is_ready' when contains(upper(y), 'READY') then 'contains_ready' when length(y) < 40 then 'too_short' else 'ok' end as reason, coalesce(try_cast(nullif(regexp_extract(token, '[01]'), '') as int), -2) as token,
  try_cast(nullif(regexp_extract(reward, 'Reward:\s*([0-1](?:\.\d+)?)', 1), '') as double) as reward, coalesce(try_cast(replace(trim(split_part(reward, 'Reward:', 2)), '*', '') as double), 0.0) as graded from s""",
)
def thinking_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a thinking text is turned down, and a judge's first token and both kinds of reward."""
    rows = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 5 == 0, " Ready\n").when(F.col("turn") % 5 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(" ready."))).otherwise(F.col("text"))
    token = F.when(F.col("conv_id") % 3 == 2, "none").otherwise(F.concat(F.lit("is "), (F.col("conv_id") % 3).cast("string"), F.lit(", not 7")))
    reward = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("so Reward: "), (F.col("conv_id") / 4 - 3).cast("decimal(20,2)").cast("string"), F.lit(" Reward:*"), F.col("turn").cast("string"), F.lit("*"))).otherwise("Reward none")
    return rows.select("conv_id", "turn", checks.thinking_reason(text, 40).alias("reason"), checks.token_score(token).alias("token"), checks.reward_number(reward).alias("reward"), checks.graded_reward(reward).alias("graded"))


@query(
    "boxed_nested",
    r"""select event_id, case event_id % 6 when 0 then '\frac{' || user_id || '}{2}' when 1 then cast(user_id as varchar) when 3 then '1' when 4 then 'x \boxed{' || user_id || '}' when 5 then '' end as answer,
  case event_id % 6 when 0 then 2 when 1 then 1 when 3 then 1 when 4 then 1 when 5 then 2 else 0 end as boxes from events""",
)
def boxed_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last boxed answer and how many there are, with braces in them; one that is never closed is none, and those before it count."""
    u, kind = F.col("user_id").cast("string"), F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("so \\boxed{1} and \\boxed{ \\frac{"), u, F.lit("}{2} } {end}"))).when(kind == 1, F.concat(F.lit("} \\boxed{"), u, F.lit("}")))
        .when(kind == 2, F.concat(F.lit("\\boxed{{"), u, F.lit("}"))).when(kind == 3, F.concat(F.lit("\\boxed{1} then \\boxed{ {"), u)).when(kind == 4, F.concat(F.lit("\\boxed{x \\boxed{"), u, F.lit("}}"))).otherwise(F.concat(F.lit("\\boxed{"), u, F.lit("}\\boxed{ }")))
    )
    return _events(spark, sf_dir).select("event_id", checks.balanced_boxed(text).alias("answer"), F.size(checks.boxed_answers(text)).alias("boxes"))


@query("answer_rewards", "select event_id, case when event_id % 5 in (0, 1, 2) and user_id = coalesce(nullif(user_id % 7, 0), user_id) then 1.0::double when event_id % 5 in (0, 1, 2) and user_id % 7 = 0 then 1.0::double else -1.0::double end as reward from events")
def answer_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in several dresses against the truth."""
    truth = F.when(F.col("user_id") % 7 == 0, F.col("user_id")).otherwise(F.col("user_id") % 7).cast("string")
    u, kind = F.col("user_id").cast("string"), F.col("event_id") % 5
    said = (
        F.when(kind == 0, F.concat(F.lit("Answer: 9\nso\nanswer : x = $"), u, F.lit("$ dollars"))).when(kind == 1, F.concat(F.lit("Answer: \\text{"), u, F.lit("}\\ cm")))
        .when(kind == 2, F.concat(F.lit("Answer: \\boxed{"), u, F.lit("}"))).when(kind == 3, u).otherwise(F.concat(F.lit("Answer: -"), u))
    )
    return _events(spark, sf_dir).select("event_id", checks.answer_reward(said, truth).alias("reward"))


@query(
    "choice_maps",
    r"""with q as (select p_partkey, p_partkey % 3 as kind, 'Which (of a) ' || p_name || '? (a) ' || p_brand || chr(10) || ' (B)  ' || replace(p_name, ' ', ' ' || chr(10) || ' ') || ' (C) ' || p_size || chr(10) || '(b) ' || p_type as p,
  'Which is it:' || chr(10) || 'A. ' || p_brand || '  x' || chr(10) || ' b) ' || p_name || chr(10) || 'C: ' || p_size || chr(10) || 'a] ' || p_type as l from part),
u as (select p_partkey, unnest(regexp_extract_all(p, '\(([A-Ia-i])\)', 1)) as k, unnest(regexp_split_to_array(p, '\s*\([A-Ia-i]\)\s*')[2:]) as v, generate_subscripts(regexp_extract_all(p, '\([A-Ia-i]\)'), 1) as i from q where kind < 2
  union all select p_partkey, unnest(regexp_extract_all(l, '\n\s*([A-Ia-i])[).:\]]', 1)), unnest(regexp_split_to_array(l, '\n\s*[A-Ia-i][).:\]]\s*')[2:]), generate_subscripts(regexp_extract_all(l, '\n\s*[A-Ia-i][).:\]]'), 1) from q where kind = 2),
m as (select p_partkey, upper(k) as k, arg_max(regexp_replace(trim(v, ' ' || chr(10)), '\s+', ' ', 'g'), i) as v from u group by 1, 2)
select p_partkey, max(v) filter (k = 'A') as a, max(v) filter (k = 'B') as b, max(v) filter (k = 'C') as c from m group by 1""",
)
def choice_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices read from questions in both styles; a letter may come twice."""
    size = F.col("p_size").cast("string")
    p = F.concat(F.lit("Which (of a) "), "p_name", F.lit("? (a) "), "p_brand", F.lit("\n (B)  "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit(" (C) "), size, F.lit("\n(b) "), "p_type")
    lines = F.concat(F.lit("Which is it:\nA. "), "p_brand", F.lit("  x\n b) "), "p_name", F.lit("\nC: "), size, F.lit("\na] "), "p_type")
    # a narrow table comes in few splits: its rows are dealt out before their texts are read
    rows = table(spark, sf_dir, "part").repartition("p_partkey").select("p_partkey", checks.choices(F.when(F.col("p_partkey") % 3 < 2, p).otherwise(lines)).alias("m"))
    return rows.select("p_partkey", *(F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in "ABC"))


@query(
    "raw_samples",
    f"""with {STEPS}, t as (select source_key, step_index, case when pred = -2 then '' else 'take ' || pred end as step, coalesce(score, 0) as score from steps), k as (select *, row_number() over (partition by source_key order by step_index) - 1 as i from t where step <> '')
select source_key, 'q' || source_key as question, count(*) as n, '[Question]' || chr(10) || 'q' || source_key || chr(10) || '[Solution]' || chr(10) || string_agg('Step ' || i || ': ' || step, '<step split>' order by i) || chr(10) || '[Answer]' || chr(10) || source_key % 5 || chr(10) as content, round(sum(score), 6) as score_sum from k where source_key % 5 > 0 group by source_key""",
)
def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples in standard form: the question's mark off, empty steps and their scores out, samples without an answer or steps dropped."""
    s = sources(spark, sf_dir)
    pairs = F.zip_with(F.col("preds"), F.col("scores"), lambda p, x: F.struct(strip(F.when(p == -2, " ").otherwise(F.concat(F.lit(" take "), p.cast("string")))).alias("step"), F.coalesce(x, F.lit(0.0)).alias("score")))
    rows = s.select("source_key", question(F.concat(F.lit(" [Question] q"), F.col("source_key").cast("string"))).alias("question"), F.filter(pairs, lambda x: x["step"] != "").alias("s"), F.when(F.col("source_key") % 5 > 0, (F.col("source_key") % 5).cast("string")).otherwise("").alias("answer"))
    rows = rows.where((F.size("s") > 0) & (F.col("answer") != "") & (F.col("question") != ""))
    numbered = F.transform("s.step", lambda x, i: F.concat(F.lit("Step "), i.cast("string"), F.lit(": "), x))
    content = F.concat(F.lit("[Question]\n"), "question", F.lit("\n[Solution]\n"), F.array_join(numbered, "<step split>"), F.lit("\n[Answer]\n"), "answer", F.lit("\n"))
    return rows.select("source_key", "question", F.size("s").cast("bigint").alias("n"), content.alias("content"), F.round(F.aggregate("s.score", F.lit(0.0), lambda a, x: a + x), 6).alias("score_sum"))


@query(
    "prompt_sections",
    f"""with {SOURCES} select source_key, 'q' || source_key as question, array_to_string(list_transform(list_filter(preds, lambda p: p <> -2), lambda p: 'take ' || p), '|') as steps, cast(source_key % 5 as varchar) as answer from sources""",
)
def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt taken apart into its sections; steps without text drop out."""
    s = sources(spark, sf_dir)
    texts = numbered_steps(F.transform("preds", lambda p: F.when(p == -2, "").otherwise(F.concat(F.lit("take "), p.cast("string")))))
    prompt = F.concat(F.lit("[Question]\nq"), F.col("source_key").cast("string"), F.lit("\n[Solution]\n"), F.array_join(texts, "<step split>"), F.lit("\n[Answer]\n"), (F.col("source_key") % 5).cast("string"), F.lit("\n"))
    section = lambda k: strip(F.regexp_extract("p", r"(?s)^\[Question\]\n(.*?)\n\[Solution\]\n(.*?)\n\[Answer\]\n(.*)$", k))
    parts = F.filter(F.transform(F.split(section(2), "<step split>"), lambda x: strip(F.regexp_replace(x, r"^Step \d+:", ""))), lambda x: x != "")
    return s.select("source_key", prompt.alias("p")).select("source_key", section(1).alias("question"), F.array_join(parts, "|").alias("steps"), section(3).alias("answer"))


@query("sharegpt_messages", "select conv_id, turn, case role when 'user' then 'user' when 'assistant' then 'assistant' when 'system' then 'system' else role end as role, text as content, row_number() over (partition by conv_id, role order by turn) - 1 as nth from conversations")
def sharegpt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under other names for roles, put into the standard ones and numbered within the role."""
    other = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", other.alias("from"), F.col("text").alias("value"))
    out = rows.select("conv_id", "turn", canonical_role(F.col("from")).alias("role"), F.col("value").alias("content"))
    return out.withColumn("nth", F.expr("cast(row_number() over (partition by conv_id, role order by turn) - 1 as bigint)"))


@query("class_to_text", "select vec_id, 'Classify: v' || vec_id || chr(10) || 'Labels: zero, one, two' as query, ['zero', 'one', 'two'][label + 1] as response from embeddings where label between 0 and 2")
def class_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes as answers of a prompt with a place for the query; rows of a class without a name drop out."""
    names = ["zero", "one", "two"]
    prompt = f"Classify: {{{{QUERY}}}}\nLabels: {', '.join(names)}"
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.replace(F.lit(prompt), F.lit("{{QUERY}}"), F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("query"), F.get(F.array(*map(F.lit, names)), F.col("label")).alias("response"))
    return rows.where("response is not null")


@query(
    "image_tags",
    r"""with t as (select conv_id, turn, (conv_id + turn) % 4 as n, regexp_split_to_array(replace(replace(coalesce(text, ''), 'the', '< Image>'), ' of ', '<image' || chr(10) || '>'), '(?i)<\s*image\s*>') as p from conversations)
select conv_id, turn, case when n >= len(p) then array_to_string(list_transform(range(n - len(p) + 1), lambda i: '<image>'), ' ') || chr(10) else '' end || p[1] || array_to_string(list_transform(range(2, len(p) + 1), lambda i: case when i - 1 <= n then '<image>' else ' image ' end || p[i]), '') as text from t""",
)
def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which tags of images stand in place of common words, put right for a number of images."""
    told = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("the"), F.lit("< Image>")), F.lit(" of "), F.lit("<image\n>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", checks.image_tags(told, (F.col("conv_id") + F.col("turn")) % 4).alias("text"))


@query("media_parts", "select conv_id, turn, coalesce(text, '') || case when turn % 2 = 1 then '<image>' else '' end || case when turn % 3 = 0 then '<audio>' else '' end as content, case when turn % 2 = 1 then 'i' || conv_id else '' end as images, case when turn % 3 = 0 then 'a' || conv_id else '' end as audios from conversations")
def media_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed content parts as one text with a tag for each medium, and the media by kind."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    c = F.col("conv_id").cast("string")
    parts = F.array(part("text", F.coalesce("text", F.lit(""))), F.when(F.col("turn") % 2 == 1, part("image", F.concat(F.lit("i"), c))), F.when(F.col("turn") % 3 == 0, part("audio", F.concat(F.lit("a"), c))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(parts, lambda p: p.isNotNull()).alias("p"))
    text = F.array_join(F.transform("p", lambda p: F.when(p["type"] == "text", p["value"]).otherwise(F.concat(F.lit("<"), p["type"], F.lit(">")))), "")
    of = lambda kind: F.array_join(F.transform(F.filter("p", lambda p: p["type"] == kind), lambda p: p["value"]), ",")
    return rows.select("conv_id", "turn", text.alias("content"), of("image").alias("images"), of("audio").alias("audios"))


@query(
    "batch_repeat",
    """with s as (select o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 as place, count(*) over () as n from orders)
select o_orderkey, k as copy, place * 3 + k as interleaved, k * n + place as tiled, place // 5 as fold, place % 5 as at, place // 64 as split from s, (values (0), (1), (2)) t(k)""",
)
def batch_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row three times, with its places when copies stand together and when the whole recurs, and the row and column of its place in rows of five."""
    rows = layout.placed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"])
    out = layout.folded(layout.repeated(rows, 3), 5).withColumn("split", layout.part(F.col("place"), 64))
    return out.select("o_orderkey", "copy", "interleaved", "tiled", F.col("row").alias("fold"), F.col("column").alias("at"), "split")


@query(
    "batch_restore",
    """with s as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as place, row_number() over (order by md5('4:' || o_orderkey), o_orderkey) - 1 as other from orders)
select a.o_orderkey, a.other as went_to, b.o_totalprice as stands_there from s a join s b on b.other = a.place""",
)
def batch_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in another order, and results in that order given back to the rows that they are of."""
    rows = layout.placed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [])
    moved = numbered(rows, [hash_order("4", "o_orderkey"), F.col("o_orderkey")], "other")
    there = moved.select(F.col("other").alias("place"), F.col("o_totalprice").alias("stands_there"))
    return moved.select("o_orderkey", "place", F.col("other").alias("went_to")).join(there, "place").drop("place")


@query("label_prefixes", f"with {STEPS}, l as (select source_key, step_index, case when score <= 0.125 then 0 when score >= 0.75 then 1 end as label from steps), p as (select *, sum(case when label is null then 1 else 0 end) over (partition by source_key order by step_index) as gone from l) select source_key, step_index, label from p where gone = 0")
def label_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories up to the first step whose label is not 0 or 1."""
    rows = steps(spark, sf_dir).select("source_key", "step_index", F.when(F.col("score") <= 0.125, 0).when(F.col("score") >= 0.75, 1).alias("label"))
    first = rows.groupBy("source_key").agg(F.min(F.when(F.col("label").isNull(), F.col("step_index"))).alias("first"))
    return rows.join(first, "source_key").where("first is null or step_index < first").select("source_key", "step_index", "label")


@query(
    "adaptive_kl",
    """with s as (select event_type, cast(ts as date) as day, avg(value) / 50 as kl, count(*) as n from events group by 1, 2), f as (select event_type, day, 1 + greatest(-0.2, least(0.2, kl / 0.9 - 1)) * n / 12 as f from s),
c as (select event_type, day, 0.2 * list_reduce(list(f) over (partition by event_type order by day), lambda a, b: a * b) as c from f) select event_type, day, cast(sign(c) as int) as sign, round(ln(nullif(abs(c), 0)), 6) as size from c""",
)
def adaptive_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign and logarithm of the coefficient after each update."""
    s = _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg((F.avg("value") / 50).alias("kl"), F.count("*").alias("n"))
    out = adaptive_coefficient(s, ["event_type"], "day", "kl", "n", 0.9, 12, 0.2)
    return out.select("event_type", "day", F.signum("coefficient").cast("int").alias("sign"), F.round(F.log(F.nullif(F.abs("coefficient"), F.lit(0.0))), 6).alias("size"))


@query("step_probabilities", "with t as (select user_id, value / 20 - 2 as l1, case when event_type <> 'error' then ln(1 + event_id % 9) end as l0, case when event_id % 97 = 0 then null else event_id % 2 end as hard from events), p as (select user_id, case when l0 is not null and l1 is not null then 1 / (1 + exp(l0 - l1)) else coalesce(hard::double, '-infinity'::double) end as p from t) select user_id, round(avg(p), 9) as score, count(p) as steps from p group by 1")
def step_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean chances of a 1, from log-probabilities or else from hard labels."""
    l0 = F.when(F.col("event_type") != "error", F.log(1 + F.col("event_id") % 9))
    hard = F.when(F.col("event_id") % 97 != 0, F.col("event_id") % 2)
    p = checks.choice_probability(l0, F.col("value") / 20 - 2, hard)
    return _events(spark, sf_dir).select("user_id", p.alias("p")).groupBy("user_id").agg(F.round(F.avg("p"), 9).alias("score"), F.count("p").alias("steps"))


@query("value_loss", "with t as (select l_returnflag as part, l_tax * 10 as v, l_discount * 10 as old, l_quantity / 50 as ret, l_linestatus = 'O' as live from lineitem), c as (select *, greatest(old - 0.2, least(old + 0.2, v)) as vc from t) select part, round(avg(greatest((v - ret) * (v - ret), (vc - ret) * (vc - ret))) filter (live) / 2, 9) as loss, round(avg(case when (vc - ret) * (vc - ret) > (v - ret) * (v - ret) then 1.0 else 0.0 end) filter (live), 9) as clipped from c group by 1")
def value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared errors of values, or of values held near the old ones where those err more, over unmasked tokens."""
    v, old, ret = F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_quantity") / 50
    held = F.greatest(old - 0.2, F.least(old + 0.2, v))
    a, b = (v - ret) * (v - ret), (held - ret) * (held - ret)
    live = F.col("l_linestatus") == "O"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("part")).agg(F.round(F.avg(F.when(live, F.greatest(a, b))) / 2, 9).alias("loss"), F.round(F.avg(F.when(live, F.when(b > a, 1.0).otherwise(0.0))), 9).alias("clipped"))


@query("infer_stats", "with d as (select user_id, event_id % 1000 as request, max(event_id % 97) as prompt, sum(event_id % 31) as generated, sum(value) as t from events group by 1, 2) select user_id % 10 as worker, count(*) as requests, cast(sum(prompt) as bigint) as prompt_tokens, cast(sum(generated) as bigint) as generated_tokens, round(count(*) / sum(t), 9) as requests_per_sec, round(sum(t) * 1000 / sum(generated), 9) as ms_per_token, coalesce(avg(nullif(generated, 0)), 0.0) as mean_generated from d group by 1")
def infer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and speed of workers, the prompt of a request counted once; means pass over what is missing."""
    e = _events(spark, sf_dir)
    d = e.groupBy("user_id", (F.col("event_id") % 1000).alias("request")).agg(F.max(F.col("event_id") % 97).alias("prompt"), F.sum(F.col("event_id") % 31).alias("generated"), F.sum("value").alias("t"))
    return d.groupBy((F.col("user_id") % 10).alias("worker")).agg(
        F.count("*").alias("requests"), F.sum("prompt").alias("prompt_tokens"), F.sum("generated").alias("generated_tokens"), F.round(F.count("*") / F.sum("t"), 9).alias("requests_per_sec"), F.round(F.sum("t") * 1000 / F.sum("generated"), 9).alias("ms_per_token"), F.coalesce(F.avg(F.nullif("generated", F.lit(0))), F.lit(0.0)).alias("mean_generated"),
    )


@query("packed_positions", "with l as (select doc_id, doc_id // 8 as pack, cast(length(text) as bigint) as n from documents where length(text) <= 5000) select pack, doc_id, sum(n) over (partition by pack order by doc_id) - n as first, sum(n) over (partition by pack) as total, max(n) over (partition by pack) as longest from l")
def packed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined into packs: where each begins, its positions starting anew at 0; rows that are too long drop out."""
    l = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 8 as pack", "cast(length(text) as bigint) as n").where("n <= 5000")
    return l.selectExpr("pack", "doc_id", "sum(n) over (partition by pack order by doc_id) - n as first", "sum(n) over (partition by pack) as total", "max(n) over (partition by pack) as longest")


@query("rouge_bigrams", """with p as (select a.conv_id, a.turn, list_filter(string_split(lower(a.text), ' '), lambda x: x <> '') as h, list_filter(string_split(lower(b.text), ' '), lambda x: x <> '') as r from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
g as (select conv_id, turn, unnest(list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1])) as g, 1 as h, 0 as r from p union all select conv_id, turn, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])), 0, 1 from p),
c as (select conv_id, turn, g, sum(h) as h, sum(r) as r from g group by 1, 2, 3), f as (select conv_id, turn, 2.0 * sum(least(h, r)) / sum(h + r) as f from c group by 1, 2 having sum(h) > 0 and sum(r) > 0) select round_even(100 * avg(f), 6) as rouge_2, count(*) as pairs from f""")
def rouge_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap F of the word pairs of neighbouring turns."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    p = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref")), ["conv_id", "turn"])
    rows = p.select("conv_id", "turn", F.inline(F.array(F.struct(F.col("text").alias("x"), F.lit(1).alias("h")), F.struct(F.col("ref").alias("x"), F.lit(0).alias("h")))))
    rows = rows.select("conv_id", "turn", "h", F.filter(F.split(F.lower("x"), " "), lambda w: w != "").alias("w"))
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, i: F.concat(a, F.lit(" "), F.get("w", i + 1)))
    c = rows.select("conv_id", "turn", "h", F.explode(pairs).alias("g")).groupBy("conv_id", "turn", "g").agg(F.sum("h").alias("h"), F.sum(1 - F.col("h")).alias("r"))
    f = c.groupBy("conv_id", "turn").agg(F.sum(F.least("h", "r")).alias("both"), F.sum("h").alias("sh"), F.sum("r").alias("sr")).where("sh > 0 and sr > 0")
    return f.agg(F.bround(100 * F.avg(2.0 * F.col("both") / (F.col("sh") + F.col("sr"))), 6).alias("rouge_2"), F.count("*").alias("pairs"))

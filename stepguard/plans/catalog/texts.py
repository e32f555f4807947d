"""Rendering rows to text and checking them from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepguard.functions.text import (
    chat_messages,
    first_match,
    fixed,
    identity_key,
    insert_turns,
    keep_lines,
    labelled_number,
    masked,
    named_values,
    record_id_in,
    render,
)
from stepguard.functions.verdicts import verdict
from stepguard.operators.evaluate import overrides
from stepguard.operators.rules import fires
from stepguard.operators.sampling import lowest_per_label
from stepguard.operators.splits import set_overlap
from stepguard.operators.stage import computed_once, read_once
from stepguard.plans import cycler as cy
from stepguard.plans import events as ev
from stepguard.plans.catalog.registry import LAB, query

TEMPLATE = """Check the event.
id：{event_id}
user：{user_id}
state：{state}

value：{value} u
before value：{previous_value} u
value jump：{value_diff} u

k：{k} n
before k：{previous_k} n
k jump：{k_diff} n

Answer yes or no."""
NUMBERS = ["value", "previous_value", "value_diff", "k", "previous_k", "k_diff"]
MISSING = "none"
DEMO_PREFIXES = [
    "state：",
    "value：",
    "before value：",
    "value jump：",
    "k：",
    "before k：",
    "k jump：",
]


def event_text() -> Column:
    fields = {n: F.col(n) for n in ("event_id", "user_id", "state")}
    fields |= {n: fixed(F.col(n), 4, MISSING) for n in NUMBERS}
    return render(TEMPLATE, fields)


def event_texts(spark, folder) -> DataFrame:
    return computed_once(ev.labelled_events(spark, folder), {"text": event_text()})


def _sql_number(name: str) -> str:
    return f"coalesce(printf('%.4f', {name}), 'none')"


_TEXT = LAB + """, tx AS (SELECT *, 'Check the event.' || chr(10) || 'id：' || event_id || chr(10) ||
   'user：' || user_id || chr(10) || 'state：' || state || chr(10) || chr(10) ||
   'value：' || {value} || ' u' || chr(10) || 'before value：' || {previous_value} || ' u' || chr(10) ||
   'value jump：' || {value_diff} || ' u' || chr(10) || chr(10) ||
   'k：' || {k} || ' n' || chr(10) || 'before k：' || {previous_k} || ' n' || chr(10) ||
   'k jump：' || {k_diff} || ' n' || chr(10) || chr(10) || 'Answer yes or no.' AS text FROM lab)
""".replace("{value}", _sql_number("value")).replace(
    "{previous_value}", _sql_number("previous_value")
).replace("{value_diff}", _sql_number("value_diff")).replace("{k}", _sql_number("k")).replace(
    "{previous_k}", _sql_number("previous_k")
).replace("{k_diff}", _sql_number("k_diff"))


@query("b16_prompt_text", _TEXT + "SELECT event_id, text FROM tx")
def b16(spark, folder):
    return event_texts(spark, folder).select("event_id", "text")


@query(
    "b17_named_values",
    LAB + """SELECT event_id, array_to_string(list_filter([
        'state：' || CASE WHEN state <> 'view' THEN state END, 'value：' || value,
        'user_id：' || CASE WHEN state <> 'click' THEN user_id END], lambda x: x IS NOT NULL), chr(10))
        AS text
      FROM (SELECT event_id, state, user_id, CASE WHEN state NOT IN ('view', 'click') THEN value END
            AS value FROM ev)
      WHERE NOT (state = 'view' AND user_id IS NULL)""",
)
def b17(spark, folder):
    df = ev.events(spark, folder).select(
        "event_id",
        F.when(F.col("state") != "view", F.col("state")).alias("state"),
        F.when(~F.col("state").isin("view", "click"), F.col("value")).alias("value"),
        F.when(F.col("state") != "click", F.col("user_id")).alias("user_id"),
    )
    named = df.withColumn("parts", named_values(["state", "value", "user_id"], "："))
    return named.filter(F.size("parts") > 0).select(
        "event_id", F.array_join("parts", "\n").alias("text")
    )


@query(
    "b18_chat_messages",
    _TEXT + """SELECT event_id, 'system|user|assistant' AS roles, sha256('Judge by rule.' || text ||
        CASE WHEN is_anomaly THEN 'yes' ELSE 'no' END) AS contents FROM tx""",
)
def b18(spark, folder):
    answer = F.when(F.col("is_anomaly"), F.lit("yes")).otherwise(F.lit("no"))
    messages = chat_messages(F.lit("Judge by rule."), F.col("text"), answer)
    df = computed_once(event_texts(spark, folder), {"messages": messages})
    contents = F.array_join(F.transform("messages", lambda m: m["content"]), "")
    return df.select(
        "event_id",
        F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"),
        F.sha2(contents, 256).alias("contents"),
    )


_LINES = """array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
  lambda x: starts_with(x, 'state：') OR starts_with(x, 'value：') OR starts_with(x, 'before value：')
   OR starts_with(x, 'value jump：') OR starts_with(x, 'k：') OR starts_with(x, 'before k：')
   OR starts_with(x, 'k jump：')), chr(10))"""


@query("b20_kept_lines", _TEXT + f"SELECT event_id, {_LINES} AS kept FROM tx")
def b20(spark, folder):
    return event_texts(spark, folder).select(
        "event_id", keep_lines(F.col("text"), DEMO_PREFIXES).alias("kept")
    )


@query(
    "b19_inserted_examples",
    _TEXT + f""", dm AS (SELECT selection_key, {_LINES} AS kept, is_anomaly FROM (
        SELECT *, sha256('42:' || event_id) AS selection_key FROM tx WHERE split = 'train')
        QUALIFY row_number() OVER (PARTITION BY is_anomaly ORDER BY selection_key) <= 2),
      ds AS (SELECT string_agg(kept || CASE WHEN is_anomaly THEN 'yes' ELSE 'no' END, ''
        ORDER BY selection_key) AS demos FROM dm)
      SELECT event_id, 'system|user|assistant|user|assistant|user|assistant|user|assistant|user' AS roles,
        sha256('Judge by rule.' || demos || text) AS contents FROM tx, ds""",
)
def b19(spark, folder):
    texts = event_texts(spark, folder)
    answer = F.when(F.col("is_anomaly"), F.lit("yes")).otherwise(F.lit("no"))
    train = texts.filter("split = 'train'").select("event_id", "is_anomaly", "text")
    chosen = lowest_per_label(train, "is_anomaly", "event_id", 2, 42)
    pair = F.array(
        F.struct(F.lit("user").alias("role"), keep_lines(F.col("text"), DEMO_PREFIXES).alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
    )
    # Two examples per label make four rows, so the turns are one small scalar.
    turns = chosen.agg(
        F.sort_array(F.collect_list(F.struct("selection_key", pair.alias("turns")))).alias("all")
    ).select(F.flatten(F.transform("all", lambda e: e["turns"])))
    messages = chat_messages(F.lit("Judge by rule."), F.col("text"), answer)
    df = computed_once(texts, {"messages": messages})
    full = df.withColumn("messages", insert_turns(F.col("messages"), turns.scalar()))
    return full.select(
        "event_id",
        F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"),
        F.sha2(F.array_join(F.transform("messages", lambda m: m["content"]), ""), 256).alias("contents"),
    )


PATTERNS = [r"\$ ?([0-9]+(?:\.[0-9]+)?)", r"([0-9]+\.[0-9]+)", r"([0-9]+)"]


@query(
    "b21_first_number",
    r"""SELECT doc_id, coalesce(
        try_cast(nullif(regexp_extract(text, '\$ ?([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE),
        try_cast(nullif(regexp_extract(text, '([0-9]+\.[0-9]+)', 1), '') AS DOUBLE),
        try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE)) AS number FROM documents""",
)
def b21(spark, folder):
    return ev.table(spark, folder, "documents").select(
        "doc_id", first_match(F.col("text"), PATTERNS).alias("number")
    )


@query(
    "b22_labelled_numbers",
    _TEXT + """SELECT event_id::VARCHAR AS record_id, round(previous_value, 4) AS before_value,
        CAST(printf('%.4f', value_diff) AS DOUBLE) AS jump, k FROM tx""",
)
def b22(spark, folder):
    text = F.col("text")
    return event_texts(spark, folder).select(
        record_id_in(text, "id").alias("record_id"),
        labelled_number(text, "before value", "u", MISSING).alias("before_value"),
        labelled_number(text, "value jump", "u", MISSING).alias("jump"),
        labelled_number(text, "k", "n", MISSING).alias("k"),
    )


def cycler_view(spark, folder) -> DataFrame:
    """Events read as battery records, for the text verifier."""
    df = ev.events(spark, folder)
    code = F.when(F.col("state") == "purchase", 110).when(F.col("state") == "error", 30).otherwise(0)
    typed = df.select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").cast("string").alias("cycle_no"),
        F.col("ts_us").cast("string").alias("ts"),
        F.col("state").alias("step_status"),
        code.alias("state"),
        code.cast("string").alias("state_text"),
        F.col("value").alias("total_voltage"),
        (F.col("value") / 1000).alias("cell_voltage"),
        F.col("k").alias("current"),
        (F.col("k") / 20).alias("temperature"),
        "ts_us",
        "event_id",
    )
    return cy.natural_samples(cy.labelled(typed, ev.ORDER))


def questions(spark, folder) -> DataFrame:
    return cycler_view(spark, folder).select(
        "record_id",
        F.col("is_anomaly").alias("gold"),
        F.element_at("messages", 2)["content"].alias("text"),
    )


_CYCLER = LAB + """, cv AS (SELECT event_id AS record_id, user_id, ts_us, event_id,
        CASE state WHEN 'purchase' THEN 110 WHEN 'error' THEN 30 ELSE 0 END AS code,
        value AS tv, value / 1000 AS cv, k AS cu, k / 20 AS te FROM ev),
      cd AS (SELECT *, CAST(printf('%.4f', abs(tv - lag(tv) OVER w)) AS DOUBLE) AS tvd,
          CAST(printf('%.4f', abs(cv - lag(cv) OVER w)) AS DOUBLE) AS cvd,
          CAST(printf('%.4f', abs(cu - lag(cu) OVER w)) AS DOUBLE) AS cud,
          CAST(printf('%.4f', abs(te - lag(te) OVER w)) AS DOUBLE) AS ted,
          abs(tv - lag(tv) OVER w) AS rtv, abs(cv - lag(cv) OVER w) AS rcv,
          abs(cu - lag(cu) OVER w) AS rcu, abs(te - lag(te) OVER w) AS rte FROM cv
        WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)),
      cf AS (SELECT *, coalesce(code = 110 AND tvd > 3.0, false) AS a1,
          coalesce(code = 110 AND cud > 0.5, false) AS a2, coalesce(cvd > 0.05, false) AS a3,
          coalesce(ted > 3.0, false) AS a4, coalesce(code = 30 AND tv > 378.2, false) AS a5,
          coalesce(code = 110 AND rtv > 3.0, false) AS g1,
          coalesce(code = 110 AND rcu > 0.5, false) AS g2, coalesce(rcv > 0.05, false) AS g3,
          coalesce(rte > 3.0, false) AS g4 FROM cd)
"""


@query(
    "b23_text_verifier",
    _CYCLER + """SELECT record_id, code AS state, (a1 OR a2 OR a3 OR a4 OR a5) AS rule_pred,
      CASE WHEN a1 OR a2 OR a3 OR a4 OR a5 THEN array_to_string(list_filter([
        CASE WHEN a1 THEN '充电总电压跳变异常：' || printf('%.6f', tvd) || 'V > 3.0V' END,
        CASE WHEN a2 THEN '充电电流跳变异常：' || printf('%.6f', cud) || 'A > 0.5A' END,
        CASE WHEN a3 THEN '单体电压跳变异常：' || printf('%.6f', cvd) || 'V > 0.05V' END,
        CASE WHEN a4 THEN '温度跳变异常：' || printf('%.6f', ted) || '℃ > 3.0℃' END,
        CASE WHEN a5 THEN '放电总电压超限：' || printf('%.6f', tv) || 'V > 378.2V' END],
        lambda x: x IS NOT NULL), '；') ELSE '无异常' END AS rule_reason FROM cf""",
)
def b23(spark, folder):
    return cy.verified(questions(spark, folder), "text").select(
        "record_id", "state", "rule_pred", "rule_reason"
    )


@query(
    "b23_text_verifier_short",
    _CYCLER + "SELECT record_id, (a1 OR a2 OR a3 OR a4 OR a5) AS rule_pred FROM cf",
)
def b23_short(spark, folder):
    out = cy.verified(questions(spark, folder), "text", digits=4, strict_labels=True)
    return out.select("record_id", "rule_pred")


@query(
    "b32_stored_differences",
    _CYCLER + """SELECT count(*) AS total, count(*) FILTER (WHERE (a1 OR a2 OR a3 OR a4)
        <> (g1 OR g2 OR g3 OR g4)) AS flips,
      count(*) FILTER (WHERE a3 <> g3) AS cell_flips FROM cf""",
)
def b32(spark, folder):
    """Labels from text differences against labels from the stored, unrounded ones."""
    df = cycler_view(spark, folder).withColumn("text", F.element_at("messages", 2)["content"])
    rules = [r for r in cy.RULES if r.kind == "jump"]
    stored = {f"stored_{c}": F.col(f"{c}_diff") for c in cy.CHANNELS}
    kept = computed_once(df.select("record_id", "text", *[c.alias(n) for n, c in stored.items()]), {"text": F.col("text")})
    parsed = read_once(kept, "text", cy.parsed_fields)
    from_text = parsed.withColumns({f"t_{r.name}": fires(r, F.col("state")) for r in rules})
    restored = from_text.withColumns(
        {f"{c}_diff": F.coalesce(f"stored_{c}", f"{c}_diff") for c in cy.CHANNELS}
    )
    both = restored.withColumns({f"s_{r.name}": fires(r, F.col("state")) for r in rules})
    any_text = F.greatest(*[F.col(f"t_{r.name}") for r in rules])
    any_stored = F.greatest(*[F.col(f"s_{r.name}") for r in rules])
    return both.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(any_text != any_stored).alias("flips"),
        F.count_if(F.col("t_cell_voltage_jump") != F.col("s_cell_voltage_jump")).alias("cell_flips"),
    )


@query(
    "b23_d22_verifier_overrides",
    _CYCLER + """, m AS (SELECT record_id, (g1 OR g2 OR g3 OR g4 OR a5) AS gold,
          (a1 OR a2 OR a3 OR a4 OR a5) AS rule_pred, tv > 60 AS model FROM cf)
      SELECT count(*) AS samples, count(*) FILTER (WHERE model <> rule_pred) AS inconsistencies,
        count(*) FILTER (WHERE model <> rule_pred AND model <> gold) AS corrected_model_errors,
        count(*) FILTER (WHERE model <> rule_pred AND model = gold) AS unnecessary_overrides,
        count(*) FILTER (WHERE gold AND rule_pred) AS final_tp,
        count(*) FILTER (WHERE NOT gold AND rule_pred) AS final_fp FROM m""",
)
def b23_overrides(spark, folder):
    checked = cy.verified(questions(spark, folder), "text")
    model = checked.withColumn("model", F.col("total_voltage") > 60)
    out = overrides(model, [], "gold", "model", "rule_pred", "rule_pred")
    return out.select(
        "samples",
        "inconsistencies",
        "corrected_model_errors",
        "unnecessary_overrides",
        "final_tp",
        "final_fp",
    )


MASKS = [(r"[0-9]+", "<N>"), (r"\b[Tt]he\b", ""), (r" +", " ")]


@query(
    "b24_masked_identity",
    r"""WITH m AS (SELECT lang, source, regexp_replace(regexp_replace(regexp_replace(text,
        '[0-9]+', '<N>', 'g'), '\b[Tt]he\b', '', 'g'), ' +', ' ', 'g') AS t FROM documents)
      SELECT lang, count(*) AS rows, count(DISTINCT (t, source)) AS keys FROM m GROUP BY lang""",
)
def b24(spark, folder):
    df = ev.table(spark, folder, "documents")
    key = identity_key(masked(F.col("text"), MASKS), F.col("source"))
    return df.select("lang", key.alias("key")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys")
    )


@query(
    "f02_signature_overlap",
    r"""SELECT count(*) AS shared FROM (
        SELECT regexp_replace(lower(line), '[^a-z]+', ' ', 'g') AS s
          FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
        INTERSECT
        SELECT regexp_replace(lower(line), '[^a-z]+', ' ', 'g')
          FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark))""",
)
def f02(spark, folder):
    def signatures(name):
        lines = ev.table(spark, folder, name).select(F.explode(F.split("text", "\n")).alias("line"))
        return lines.select(masked(F.lower("line"), [("[^a-z]+", " ")]).alias("s"))

    return set_overlap(signatures("documents"), signatures("benchmark"))


@query(
    "b25_verdict_text",
    r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+', '') AS s FROM documents),
      h AS (SELECT *, substr(s, 1, 40) AS a, substr(s, 1, 30) AS b FROM t)
      SELECT doc_id, CASE WHEN starts_with(s, 'th') THEN true WHEN starts_with(s, 'in') THEN false
          WHEN contains(a, 'th') AND NOT contains(a, 'in') THEN true
          WHEN contains(a, 'in') THEN false END AS first_rule,
        CASE WHEN starts_with(s, 'th') THEN true WHEN starts_with(s, 'in') THEN false
          WHEN contains(b, 'th') AND NOT contains(b, 'in') THEN true
          WHEN contains(b, 'in') AND NOT contains(b, 'th') THEN false END AS exclusive_rule FROM h""",
)
def b25(spark, folder):
    df = ev.table(spark, folder, "documents")
    text = F.col("text")
    return df.select(
        "doc_id",
        verdict(text, "th", "in", 40, exclusive=False).alias("first_rule"),
        verdict(text, "th", "in", 30, exclusive=True).alias("exclusive_rule"),
    )

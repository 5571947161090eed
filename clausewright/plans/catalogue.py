"""All registered queries of the ledger engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.functions import money, text
from clausewright.operators import ledger, retrieval
from clausewright.sources.tables import AS_OF, SQL, contracts, plans, table

FLAGSHIP = "ag_plan_summary"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WITH = f"WITH {SQL}"
STATES = ["draft", "approval", "seal", "archived", "void"]
PAYING = ["draft", "confirmed", "partial", "paid", "cancelled"]
NODES = [("prepayment", 0.3, 5), ("on_delivery", 0.6, 60), ("final", 0.1, 365)]
TOPICS = [("offer", ["the", "and"]), ("auftrag", ["der", "die"]), ("contrato", ["que", "las"])]
WEIGHTS = {"en": [("the", 1), ("and", 1), ("of", 2)], "de": [("der", 2), ("und", 1)], "fr": [("les", 1), ("dans", 3)], "es": [("los", 2), ("del", 2)]}
OVERDUE = f"(p.state NOT IN ('paid', 'cancelled') AND p.planned_date < DATE '{AS_OF}' AND p.actual IS NULL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SUMMARY = f"""summary AS (
  SELECT c.*, coalesce(s.plan_count, 0) AS plan_count, coalesce(s.overdue_count, 0) AS overdue_count, CAST(coalesce(s.planned_total, 0) AS DECIMAL(38,2)) AS planned_total,
    CAST(coalesce(s.paid_total, 0) AS DECIMAL(38,2)) AS paid_total, CAST(coalesce(s.planned_total, 0) - coalesce(s.paid_total, 0) AS DECIMAL(38,2)) AS remaining_total
  FROM contracts c LEFT JOIN (
    SELECT contract_id, count(*) AS plan_count, sum(planned) AS planned_total, sum(actual) FILTER (state = 'paid') AS paid_total, count(*) FILTER {OVERDUE.replace('(p.', '(WHERE p.', 1)} AS overdue_count
    FROM plans p GROUP BY contract_id) s ON c.id = s.contract_id)"""


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.plan_summary(contracts(spark, sf), plans(spark, sf), AS_OF)


@query(f"{WITH}, {SUMMARY} SELECT * FROM summary")
def ag_plan_summary(spark, sf):
    return summary(spark, sf)


@query(f"{WITH}, {SUMMARY} SELECT s.*, c_name AS partner_a_name FROM summary s LEFT JOIN customer ON c_custkey = partner_a")
def so_export(spark, sf):
    return ledger.export_order(ledger.with_partners(summary(spark, sf), table(spark, sf, "customer")))


@query(f"""{WITH}, {SUMMARY}, t AS (SELECT type, count(*) AS n, sum(amount) AS a, sum(paid_total) AS p, grouping(type) AS g FROM summary GROUP BY ROLLUP (type))
SELECT CASE WHEN g = 1 THEN 'TOTAL' ELSE type END AS type, n, CAST(a AS DECIMAL(38,2)) AS amount, CAST(p AS DECIMAL(38,2)) AS paid, printf('%.1f%%', CASE WHEN a = 0 THEN 0.0 ELSE CAST(p AS DOUBLE) / CAST(a AS DOUBLE) * 100 END) AS paid_pct FROM t""")
def ag_type_summary(spark, sf):
    return ledger.type_summary(summary(spark, sf))


@query(f"""{WITH}, {SUMMARY} SELECT CASE WHEN grouping(type) = 1 THEN 'ALL' ELSE coalesce(type, 'NONE') END AS type, CASE WHEN grouping(state) = 1 THEN 'ALL' ELSE coalesce(state, 'NONE') END AS state,
CAST(sum(amount) AS DECIMAL(38,2)) AS amount, CAST(sum(planned_total) AS DECIMAL(38,2)) AS planned_total, CAST(sum(paid_total) AS DECIMAL(38,2)) AS paid_total FROM summary GROUP BY ROLLUP (type, state)""")
def ag_pivot_contract(spark, sf):
    return ledger.pivot(summary(spark, sf), ["type", "state"], ["amount", "planned_total", "paid_total"])


DIRECTION = "CASE WHEN type IN ('purchase', 'lease') THEN 'payable' WHEN type IN ('sale', 'service') THEN 'receivable' END"


def plans_of_type(spark, sf):
    c = contracts(spark, sf).select(F.col("id").alias("contract_id"), "type").withColumn("direction", ledger.direction())
    return plans(spark, sf).withColumn("remaining", ledger.remaining()).join(c, "contract_id")


@query(f"""{WITH}, x AS (SELECT p.*, c.type, {DIRECTION} AS direction, planned - coalesce(actual, 0) AS remaining FROM plans p JOIN contracts c ON c.id = p.contract_id)
SELECT CASE WHEN grouping(type) = 1 THEN 'ALL' ELSE coalesce(type, 'NONE') END AS type, CASE WHEN grouping(direction) = 1 THEN 'ALL' ELSE coalesce(direction, 'NONE') END AS direction, CASE WHEN grouping(state) = 1 THEN 'ALL' ELSE state END AS state,
CAST(sum(planned) AS DECIMAL(38,2)) AS planned, CAST(sum(actual) AS DECIMAL(38,2)) AS actual, CAST(sum(remaining) AS DECIMAL(38,2)) AS remaining FROM x GROUP BY ROLLUP (type, direction, state)""")
def ag_pivot_plan(spark, sf):
    return ledger.pivot(plans_of_type(spark, sf), ["type", "direction", "state"], ["planned", "actual", "remaining"])


@query(f"{WITH} SELECT d.ord, d.state, count(c.id) AS n FROM (VALUES {', '.join(f'({i}, {s!r})' for i, s in enumerate(STATES))}) d(ord, state) LEFT JOIN contracts c ON c.state = d.state GROUP BY 1, 2")
def ag_group_expand(spark, sf):
    return ledger.expand_groups(contracts(spark, sf), "state", STATES)


@query(f"""{WITH} SELECT contract_id, count(*) AS n, string_agg(CAST(planned_date AS VARCHAR) || ' ' || CAST(planned AS VARCHAR), '; ' ORDER BY planned_date, planned, line, part) AS lines
FROM plans WHERE state IN ('draft', 'confirmed', 'partial') AND planned_date < DATE '{AS_OF}' AND actual IS NULL GROUP BY contract_id""")
def ag_overdue_by_contract(spark, sf):
    return ledger.overdue_lines(plans(spark, sf), AS_OF)


@query(f"{WITH} SELECT party, count(*) AS n FROM (SELECT partner_a AS party FROM contracts UNION ALL SELECT partner_b FROM (SELECT DISTINCT contract_id, partner_b FROM plans)) GROUP BY party")
def ag_counterparty_count(spark, sf):
    return ledger.party_counts(contracts(spark, sf), plans(spark, sf))


@query(f"{WITH} SELECT id, CASE WHEN date_end < DATE '{AS_OF}' AND state = 'seal' THEN 'archived' ELSE state END AS state FROM contracts")
def cr_expire(spark, sf):
    return ledger.expired(contracts(spark, sf), AS_OF).select("id", "state")


@query(f"{WITH} SELECT contract_id, line, part, partner_b, planned, {OVERDUE} AS overdue, CAST(planned - coalesce(actual, 0) AS DECIMAL(18,2)) AS remaining FROM plans p")
def ps_overdue_remaining(spark, sf):
    p = plans(spark, sf)
    return p.select("contract_id", "line", "part", "partner_b", "planned", ledger.is_overdue(AS_OF).alias("overdue"), ledger.remaining().cast("decimal(18,2)").alias("remaining"))


@query(f"{WITH} SELECT id, type, {DIRECTION} AS direction FROM contracts")
def ps_direction(spark, sf):
    return contracts(spark, sf).select("id", "type", ledger.direction().alias("direction"))


@query(f"""{WITH}, n AS (SELECT * FROM (VALUES (1, 'prepayment', 0.3, 5), (2, 'on_delivery', 0.6, 60), (3, 'final', 0.1, 365)) n(seq, name, p, d))
SELECT id, seq, name, CAST(round(CAST(amount * CAST(p AS DECIMAL(5,4)) AS DECIMAL(38,6)), 2) AS DECIMAL(38,2)) AS planned, date_signed + d AS planned_date FROM contracts, n WHERE amount > 0""")
def ps_generate(spark, sf):
    return ledger.schedule(contracts(spark, sf), NODES)


@query(f"{WITH}, {SUMMARY} SELECT id, CASE WHEN plan_count > 0 THEN abs(CAST(planned_total AS DOUBLE) - CAST(amount AS DOUBLE)) <= greatest(0.01, abs(CAST(amount AS DOUBLE)) * 0.01) END AS ok FROM summary")
def dq_schedule(spark, sf):
    s = summary(spark, sf)
    return s.select("id", ledger.sum_check(F.col("amount").cast("double"), F.when(F.col("plan_count") > 0, F.col("planned_total").cast("double"))).alias("ok"))


@query(f"{WITH} SELECT contract_id, line, part, planned, row_number() OVER (PARTITION BY contract_id ORDER BY line, part, partner_b, planned, planned_date) AS seq FROM plans")
def wn_seq(spark, sf):
    return ledger.numbered(plans(spark, sf), "contract_id", "line", "part", "partner_b", "planned", "planned_date").select("contract_id", "line", "part", "planned", "seq")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def wn_latest(spark, sf):
    return ledger.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ck_unique(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(f"{WITH} SELECT contract_id, line, part, planned FROM plans WHERE NOT planned > 1000")
def ck_positive(spark, sf):
    return plans(spark, sf).where(~(F.col("planned") > 1000)).select("contract_id", "line", "part", "planned")


@query(f"{WITH} SELECT id FROM contracts WHERE date_signed > date_end")
def ck_date_range(spark, sf):
    return contracts(spark, sf).where("date_signed > date_end").select("id")


@query(f"{WITH} SELECT c.id FROM contracts c WHERE EXISTS (SELECT 1 FROM contracts d WHERE d.partner_a = c.partner_a AND d.date_signed = c.date_signed AND d.id <> c.id)")
def jn_dup_code(spark, sf):
    c = contracts(spark, sf).select("id", "partner_a", "date_signed")
    # a pair exists where the key's least and greatest id differ: one aggregate, no pairs
    keys = c.groupBy("partner_a", "date_signed").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b")
    return c.join(keys, ["partner_a", "date_signed"], "left_semi").select("id")


@query(f"{WITH} SELECT id FROM contracts WHERE id NOT IN (SELECT contract_id FROM plans)")
def jn_exclude(spark, sf):
    return contracts(spark, sf).join(plans(spark, sf).select(F.col("contract_id").alias("id")), "id", "left_anti").select("id")


@query(f"{WITH} SELECT partner_a AS party, id FROM contracts UNION SELECT partner_b, contract_id FROM plans")
def set_union_distinct(spark, sf):
    return contracts(spark, sf).select(F.col("partner_a").alias("party"), "id").union(plans(spark, sf).select("partner_b", "contract_id")).distinct()


@query(f"{WITH} SELECT contract_id AS id, 'kept' AS origin FROM plans WHERE state <> 'draft' UNION ALL SELECT id, 'new' FROM contracts WHERE state = 'approval'")
def set_replace_by_source(spark, sf):
    now = plans(spark, sf).select(F.col("contract_id").alias("id"), F.col("state").alias("source"))
    new = contracts(spark, sf).where("state = 'approval'").select("id", F.lit("draft").alias("source"))
    return ledger.replace_by_source(now, new, "draft").select("id", F.when(F.col("source") == "draft", "new").otherwise("kept").alias("origin"))


@query(f"{WITH} SELECT id, type FROM contracts WHERE (type = 'sale' OR type = 'lease') AND amount >= 100000")
def flt_meta(spark, sf):
    return contracts(spark, sf).where(ledger.compile_filter({"$or": [{"type": "sale"}, {"type": "lease"}], "amount": {"$gte": 100000}})).select("id", "type")


@query(f"{WITH} SELECT id, code FROM contracts WHERE state IN ('seal', 'approval') AND date_signed >= DATE '1996-01-01' AND code ILIKE '%12%'")
def flt_domain(spark, sf):
    return contracts(spark, sf).where(F.col("state").isin("seal", "approval") & (F.col("date_signed") >= F.lit("1996-01-01").cast("date")) & F.col("code").ilike("%12%")).select("id", "code")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS snippet FROM documents")
def prj_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), 80).alias("snippet"))


@query("""SELECT doc_id, coalesce(CASE WHEN length(l) > 60 THEN left(l, 60) || '…' ELSE l END, '') AS preview FROM (
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS l FROM documents)""")
def prj_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''),
lambda x: '<p>' || replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>'), '') AS html FROM documents""")
def snk_html(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.to_html(F.col("text")).alias("html"))


@query("SELECT doc_id, replace(lower(trim(text, ' ')), ' ', '') AS norm FROM documents")
def tx_norm_str(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.norm_str(F.col("text")).alias("norm"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[，。；：、 \t\n\r,;:]+'), lambda x: x <> '')) AS n FROM documents")
def tx_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


@query("""SELECT doc_id, CASE WHEN trim(text, ' ') = '' THEN 0.0 ELSE round(least(1.0, greatest(0.0, 0.5 * (length(text) - length(regexp_replace(text, '[\\p{L}0-9 .,;:!?\\n]', '', 'g'))) / length(text) + 0.5)), 3) END AS score FROM documents""".replace("\\\\", "\\"))
def fn_readability(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.readability(F.col("text")).alias("score"))


@query("SELECT doc_id, CASE WHEN contains(t, 'the') OR contains(t, 'and') THEN 'offer' WHEN contains(t, 'der') OR contains(t, 'die') THEN 'auftrag' WHEN contains(t, 'que') OR contains(t, 'las') THEN 'contrato' ELSE 'other' END AS topic FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def tx_clause_type(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_hit(F.col("text"), TOPICS).alias("topic"))


@query()
def tx_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


def keyword_scores(t):
    return {k: sum((text.count_of(t, w) * n for w, n in words), F.lit(0)) for k, words in WEIGHTS.items()}


def _count(w: str) -> str:
    return f"((length(text) - length(replace(text, '{w}', ''))) // {len(w)})"


SCORES = ", ".join(" + ".join(f"{_count(w)} * {n}" for w, n in words) + f" AS {k}" for k, words in WEIGHTS.items())
TOP = ", ".join(f"{{'s': {k}, 'o': {-i}, 'k': '{k}'}}" for i, k in enumerate(WEIGHTS))


@query(f"SELECT doc_id, {SCORES} FROM documents")
def cl_keyword(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[c.cast("long").alias(k) for k, c in keyword_scores(F.col("text")).items()])


@query(f"""WITH k AS (SELECT doc_id, {SCORES} FROM documents), x AS (SELECT *, list_sort([{TOP}]) AS l, en + de + fr + es AS total FROM k), y AS (SELECT doc_id, l[4].s AS top, l[3].s AS second, l[4].k AS kind, total FROM x)
SELECT doc_id, CASE WHEN top = 0 THEN 'other' ELSE kind END AS kind, CASE WHEN top = 0 THEN 0.3 WHEN second > 0 AND top > 2 * second THEN round(least(0.85, greatest(0.55, top / total + 0.25)), 3) WHEN top >= 8 THEN 0.75 WHEN top >= 5 THEN 0.65 WHEN top >= 2 THEN 0.5 ELSE 0.4 END AS conf FROM y""")
def cl_rule_pick(spark, sf):
    s = keyword_scores(F.col("text"))
    x = table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in s.items()])
    x = x.withColumn("l", F.array_sort(F.array(*[F.struct(F.col(k).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(s)])))
    x = x.select("doc_id", F.expr("l[3].s").alias("top"), F.expr("l[2].s").alias("second"), F.expr("l[3].k").alias("kind"), F.expr("en + de + fr + es").alias("total"))
    lead = F.round(F.least(F.lit(0.85), F.greatest(F.lit(0.55), F.col("top") / F.col("total") + 0.25)), 3)
    conf = F.when(F.col("top") == 0, 0.3).when((F.col("second") > 0) & (F.col("top") > 2 * F.col("second")), lead).when(F.col("top") >= 8, 0.75).when(F.col("top") >= 5, 0.65).when(F.col("top") >= 2, 0.5).otherwise(0.4)
    return x.select("doc_id", F.when(F.col("top") == 0, "other").otherwise(F.col("kind")).alias("kind"), conf.alias("conf"))


NEAREST = """p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS r FROM p)"""


def nearest(spark, sf, k):
    """The k nearest of every vector for those whose id is divisible by 20, the stated query set."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k)


@query(f"WITH {NEAREST} SELECT query_id, vec_id, sim FROM n WHERE r <= 5")
def tk_vector(spark, sf):
    return nearest(spark, sf, 5).select("query_id", "vec_id", "sim")


@query("SELECT label, count(*) AS examples, count(DISTINCT vec_id // 10) AS groups FROM embeddings GROUP BY label")
def ag_vec_stats(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("examples"), F.count_distinct(F.expr("vec_id div 10")).alias("groups"))


@query("""SELECT l.doc_id, (length(d.text) > 1000) AS predicted, (l.quality = 1) AS gold, (length(d.text) > 1000) = (l.quality = 1) AS hit FROM labels l JOIN documents d USING (doc_id)""")
def jn_gold(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", (F.length("text") > 1000).alias("predicted")), "doc_id")
    return j.select("doc_id", "predicted", (F.col("quality") == 1).alias("gold"), (F.col("predicted") == (F.col("quality") == 1)).alias("hit"))


@query("""WITH j AS (SELECT d.lang, (length(d.text) > 1000) = (l.quality = 1) AS hit FROM labels l JOIN documents d USING (doc_id))
SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, count(*) AS n, round(avg(CAST(hit AS INT)), 4) AS accuracy FROM j GROUP BY ROLLUP (lang)""")
def ag_accuracy(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.length("text") > 1000).alias("p"))
    j = table(spark, sf, "labels").join(d, "doc_id").select("lang", (F.col("p") == (F.col("quality") == 1)).cast("int").alias("hit"))
    t = j.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 4).alias("accuracy"), F.grouping("lang").alias("g"))
    return t.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("lang")).alias("lang"), "n", "accuracy")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def wn_next_start(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.row_number().over(w) - 1).alias("i"), F.lead("turn").over(w).alias("next_turn"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def sm_daily_log(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars, CASE WHEN length(regexp_replace(html, '<[^>]*>', '', 'g')) < 50 THEN 'scanned' WHEN length(regexp_replace(html, '<[^>]*>', '', 'g')) < 100 THEN 'mixed' ELSE 'text' END AS class FROM pages""")
def fn_legacy_class(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("chars"))
    return p.select("page_id", "chars", F.when(F.col("chars") < 50, "scanned").when(F.col("chars") < 100, "mixed").otherwise("text").alias("class"))

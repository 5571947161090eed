"""Registered queries on contract texts, collections, files' records and streams, and their SQL; importing adds them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewright.functions import checks, fields, text, udf
from clausewright.operators import classify, clauses, layout, ledger, retrieval
from clausewright.plans.catalogue import NEAREST, WITH, nearest, query
from clausewright.plans.review import MATCHED, TOKENS, docs, matched
from clausewright.sources import files
from clausewright.sources.tables import AS_OF, contracts, plans, table
from clausewright.streaming import machines

SAMPLE = """设备采购合同
合同编号：CG-20260801-0001
甲方（买方）：XX 科技有限公司
乙方（卖方）：YY 信息技术有限公司
每台单价人民币 5 万元，合同总金额为人民币 500,000 元。
大写：伍拾万元整
签订日期：2026-08-01
争议向人民法院提起诉讼。"""
RECORD = {"contract_code": "CG-20260801-0001", "partner_a": "XX 科技有限公司", "partner_b": "YY 信息技术有限公司", "amount": 500000.0, "amount_uppercase": "伍拾万元整", "sign_date": "2026-08-01", "dispute_resolution": "向人民法院提起诉讼", "currency": "CNY"}
NAMES = list(fields.FILLERS)
DDL = "i int, text string, " + ", ".join(f"{n} {'double' if n == 'amount' else 'string'}" for n in NAMES)
#: What the checked records have other than RECORD.
CHANGES = [{}, {"amount": 9999999.0}, {"sign_date": "2026-12-25"}, {"partner_b": "某某"}, {"amount": 0.0}, {"amount": 2e10}, {"sign_date": "2026年3月15日"}, {"sign_date": "2026-02-30"}, {"sign_date": "1980-01-01"}, {"dispute_resolution": "决斗解决"}, {"contract_code": None}, {"effective_date": "2026-07-01"}]


def records(spark, changes):
    return spark.createDataFrame([(i, SAMPLE, *[{**RECORD, **c}.get(n) for n in NAMES]) for i, c in enumerate(changes)], DDL)


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, false)) t(i, found)")
def ev_fuzzy(spark, sf):
    d = spark.createDataFrame([(0, "YY 信息技术有限公"), (1, "ＸＸ科技有限公司"), (2, "某某集团")], "i int, name string")
    return d.select("i", udf.fuzzy_in("name", F.lit("YY 信息技术有限公司\nXX 科技有限公司")).alias("found"))


@query(r"""SELECT doc_id, CASE WHEN contains(text, 'AKIA') THEN 'key' WHEN regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'dated' END AS v FROM documents""")
def tk_first_match(spark, sf):
    return docs(spark, sf).select("doc_id", fields.one_of(F.col("text"), [("AKIA", "key"), ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "dated")]).alias("v"))


@query()
def tx_norm_text(spark, sf):
    return docs(spark, sf).select("doc_id", udf.nfkc("text").alias("norm"))


@query()
def fn_seq_ratio(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(udf.seq_ratio("p_name", "p_type"), 4).alias("ratio"))


@query()
def tx_obligation_excerpt(spark, sf):
    return docs(spark, sf).select("doc_id", text.lines_with(F.col("text"), ["the", "der", "les", "los"]).alias("excerpt"))


@query(f"{WITH} SELECT id, 'Contract ' || code || ', ' || coalesce(type, '') || ', {{unknown}}' AS text FROM contracts")
def tx_render_prompt(spark, sf):
    return contracts(spark, sf).select("id", files.rendered("Contract {code}, {type}, {unknown}", code=F.col("code"), type=F.col("type")).alias("text"))


@query("SELECT doc_id, replace(text, chr(0), '') AS text FROM documents")
def prj_strip_nul(spark, sf):
    return docs(spark, sf).select("doc_id", text.without_nul(F.col("text")).alias("text"))


@query(f"{WITH} SELECT p.contract_id, p.line, p.part, p.planned, c.type, c.code, c.amount, c.date_signed FROM plans p JOIN contracts c ON c.id = p.contract_id")
def prj_related(spark, sf):
    c = contracts(spark, sf).select(F.col("id").alias("contract_id"), "type", "code", "amount", "date_signed")
    return plans(spark, sf).select("contract_id", "line", "part", "planned").join(c, "contract_id")


LABELS = {"purchase": "采购合同", "sale": "销售合同", "service": "服务合同", "lease": "租赁合同", "other": "其他"}


@query(f"{WITH} SELECT id, CASE type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in LABELS.items())} END AS label FROM contracts")
def prj_type_map(spark, sf):
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return contracts(spark, sf).select("id", labels[F.col("type")].alias("label"))


@query(f"{WITH} SELECT id, date_signed AS sign_date, date_end AS expire_date FROM contracts")
def prj_field_alias(spark, sf):
    return contracts(spark, sf).select("id", "date_signed", "date_end").withColumnsRenamed({"date_signed": "sign_date", "date_end": "expire_date"})


FILTERS = {"state": {"sealed": "state = 'seal'", "archived": "state = 'archived'"}, "type": {"sale": "type = 'sale'", "lease": "type = 'lease'"}, "size": {"large": "amount >= 100000"}}


@query(f"{WITH} SELECT id FROM contracts WHERE (state = 'seal' OR state = 'archived') AND (type = 'sale' OR type = 'lease') AND amount >= 100000")
def flt_saved(spark, sf):
    return ledger.saved_filters(contracts(spark, sf), FILTERS, ["sealed", "archived", "sale", "lease", "large"]).select("id")


@query(f"{WITH} SELECT id FROM contracts LEFT JOIN customer ON c_custkey = partner_a WHERE code ILIKE '%77%' OR c_name ILIKE '%77%'")
def flt_search_field(spark, sf):
    named = ledger.with_partners(contracts(spark, sf), table(spark, sf, "customer"))
    return named.where(F.col("code").ilike("%77%") | F.col("partner_a_name").ilike("%77%")).select("id")


@query(f"{WITH} SELECT id, type, state, amount, date_signed FROM contracts")
def so_default(spark, sf):
    return contracts(spark, sf).select("id", "type", "state", "amount", "date_signed").orderBy(F.desc_nulls_first("date_signed"), F.desc("id"))


@query("SELECT 1 AS doc_id, 1 AS page, '甲方：张三 乙方：李四' || chr(10) || chr(10) || '第一条 付款' AS text")
def wn_row_cluster(spark, sf):
    rows = [(1, 1, "乙方：李四", 200, 10, 300, 30), (1, 1, "甲方：张三", 10, 12, 110, 32), (1, 1, "第一条 付款", 10, 100, 110, 120)]
    return layout.reading_order(spark.createDataFrame(rows, "doc_id long, page int, text string, x1 int, y1 int, x2 int, y2 int"))


@query("SELECT * FROM (VALUES (1, 1, true), (1, 2, false), (2, 1, false)) t(page, ord, sealed)")
def jn_seal(spark, sf):
    b = spark.createDataFrame([(1, 1, 1, 0, 0, 10, 10), (1, 1, 2, 50, 50, 60, 60), (1, 2, 1, 0, 0, 10, 10)], "doc_id long, page int, ord int, x1 int, y1 int, x2 int, y2 int")
    s = spark.createDataFrame([(1, 1, 5, 5, 20, 20)], "doc_id long, page int, x1 int, y1 int, x2 int, y2 int")
    return layout.sealed(b, s).select("page", "ord", "sealed")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS total, count(*) FILTER (WHERE value < 340) AS low, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE value < 10) AS worst FROM events GROUP BY user_id")
def ag_block_merge(spark, sf):
    worst = F.array_sort(F.collect_list(F.when(F.col("value") < 10, F.col("event_id"))))
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("value") < 340).alias("low"), worst.alias("w"))
    return g.select("user_id", "total", "low", F.when(F.size("w") > 0, F.array_join("w", ",")).alias("worst"))


@query("SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def ag_clause_count(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"))


@query(f"{WITH} SELECT id, CAST(sum(CASE WHEN p.actual <> 0 THEN p.actual ELSE CAST(amount AS DECIMAL(18,2)) * CAST(0.5 AS DECIMAL(2,1)) END) AS DECIMAL(38,3)) AS total FROM contracts JOIN plans p ON contract_id = id GROUP BY id")
def ag_schedule_total(spark, sf):
    c = contracts(spark, sf).select("id", "amount")
    paid = F.col("actual") != 0
    p = plans(spark, sf).groupBy(F.col("contract_id").alias("id")).agg(F.coalesce(F.sum(F.when(paid, F.col("actual"))), F.lit(0)).alias("s"), F.count_if(~F.coalesce(paid, F.lit(False))).alias("n"))
    return c.join(p, "id").select("id", F.expr("cast(s + cast(n as decimal(10,0)) * amount * 0.5 as decimal(38,3))").alias("total"))


@query("SELECT p_brand, count(*) AS n, round(avg(levenshtein(p_name, p_type) / length(p_name)), 4) AS cer FROM part WHERE length(p_name) > 0 GROUP BY p_brand")
def ag_cer_scene(spark, sf):
    p = table(spark, sf, "part").where(F.length("p_name") > 0)
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg(F.levenshtein("p_name", "p_type") / F.length("p_name")), 4).alias("cer"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE (r - 1) % 3 = 0 AND r <= 90")
def wn_sample(spark, sf):
    r = table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("r"))
    return r.where("(r - 1) % 3 = 0 AND r <= 90").select("conv_id", "turn")  # a systematic sample: the feature itself


@query("SELECT item_id, length(text) > 200 AS over FROM benchmark")
def ck_upload_size(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", (F.length("text") > 200).alias("over"))


EXAMPLES = f"""WITH {NEAREST}, h AS (SELECT * FROM n WHERE r <= 100), b AS (SELECT query_id, vec_id // 10 AS example_id, vec_id, sim, r, row_number() OVER (PARTITION BY query_id, vec_id // 10 ORDER BY sim DESC, r) AS o FROM h),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, r) AS rank FROM b WHERE o = 1 AND example_id <> query_id // 10)"""


@query(f"{EXAMPLES} SELECT query_id, example_id, vec_id, sim, rank AS r FROM x WHERE rank <= 5")
def tk_example(spark, sf):
    hits = nearest(spark, sf, 100).withColumn("example_id", F.expr("vec_id div 10"))
    return retrieval.best_examples(hits.where("example_id <> query_id div 10"), 5)  # the query's own example is left out


@query(f"WITH {NEAREST}, h AS (SELECT query_id, vec_id, CASE WHEN query_id % 40 = 0 THEN (vec_id % 7) / 7.0 WHEN vec_id % 2 = 0 THEN 1.0 END AS z, sim FROM n WHERE r <= 5), s AS (SELECT query_id, vec_id, CASE WHEN count(z) OVER (PARTITION BY query_id) = count(*) OVER (PARTITION BY query_id) THEN z ELSE sim END AS score FROM h) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s")
def tk_rerank(spark, sf):
    z = F.when(F.col("query_id") % 40 == 0, (F.col("vec_id") % 7) / 7.0).when(F.col("vec_id") % 2 == 0, 1.0)
    return retrieval.reranked(nearest(spark, sf, 5).withColumn("rerank", z))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT -1, -1")
def snk_vector(spark, sf):
    now = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = now.where("id % 3 = 0").select("id", F.lit(-1).alias("label")).unionByName(spark.createDataFrame([(-1, -1)], "id long, label int"))
    return retrieval.upserted(now, new, "id")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark) AND (label <> 3 OR label IS NULL)")
def snk_vector_delete(spark, sf):
    now = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return retrieval.deleted(now, table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), F.col("label") == 3)


@query()
def tx_few_shot(spark, sf):
    # one character more than a block shows, so that it still knows whether the text is cut
    start = F.left(F.coalesce("text", F.lit("")), F.lit(retrieval.SHOWN + 1))
    hits = nearest(spark, sf, 3).join(docs(spark, sf).select(F.col("doc_id").alias("vec_id"), start.alias("text")), "vec_id")
    return retrieval.few_shot(hits)


#: Payments that a model named: (share, sum, days after signing).
SAID = [("0.3", "NULL", "5"), ("NULL", "1000", "NULL"), ("NULL", "0", "NULL"), ("0.2", "NULL", "NULL")]


@query(f"""{WITH}, a AS (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({r} AS DECIMAL(5,4)), CAST({s} AS DECIMAL(18,2)), CAST({d} AS INT))' for i, (r, s, d) in enumerate(SAID, 1))}) a(seq, ratio, said, days)),
g AS (SELECT id, seq, CAST(round(CASE WHEN said IS NOT NULL AND said <> 0 THEN said WHEN ratio IS NOT NULL THEN amount * ratio ELSE 0 END, 2) AS DECIMAL(18,2)) AS planned, date_signed + coalesce(days, 30 * (seq - 1)) AS planned_date FROM contracts, a) SELECT * FROM g WHERE planned > 0""")
def ps_generate_ai(spark, sf):
    return ledger.named_payments(contracts(spark, sf), [tuple(None if x == "NULL" else x for x in n) for n in SAID])


@query(f"{MATCHED}, a AS (SELECT type, avg(CAST(amount_ok AS INT)) AS x, avg(CAST(date_ok AS INT)) AS y FROM m GROUP BY type) SELECT type, round((x - y) * 100, 2) AS delta, CASE WHEN (x - y) * 100 >= 5 THEN 'better' WHEN x >= y THEN 'even' ELSE 'worse' END AS verdict FROM a")
def evl_delta(spark, sf):
    a = matched(spark, sf).groupBy("type").agg(F.avg(F.col("amount_ok").cast("int")).alias("x"), F.avg(F.col("date_ok").cast("int")).alias("y"))
    d = (F.col("x") - F.col("y")) * 100
    return a.select("type", F.round(d, 2).alias("delta"), F.when(d >= 5, "better").when(d >= 0, "even").otherwise("worse").alias("verdict"))


PAIRS = f"t AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations), p AS (SELECT conv_id, turn, q AS context, list_distinct({TOKENS.format('a')}) AS w FROM t WHERE q IS NOT NULL AND a IS NOT NULL)"


def pairs(spark, sf):
    """Each turn as the context of the words of the next."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("context"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("a"))
    return t.dropna(subset=["context", "a"]).withColumn("w", F.array_distinct(F.filter(text.tokens(F.col("a")), lambda x: F.length(x) >= 2)))


CONTAINED = "CASE WHEN len(w) = 0 THEN {} ELSE round(len(list_filter(w, lambda x: contains(context, x))) / len(w), 4) END AS score"


@query(f"WITH {PAIRS} SELECT conv_id, turn, {CONTAINED.format('1.0')} FROM p")
def evl_ctx_recall(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.when(F.size("w") == 0, 1.0).otherwise(fields.containment(F.col("w"), F.col("context"))).alias("score"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {CONTAINED.format('0.0')} FROM p")
def evl_faithful(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", fields.containment(F.col("w"), F.col("context")).alias("score"))


@query(f"WITH {PAIRS}, s AS (SELECT conv_id, {CONTAINED.format('1.0')} FROM p) SELECT conv_id, count(*) AS n, round(avg(score), 3) AS recall FROM s GROUP BY conv_id")
def ag_rag_metrics(spark, sf):
    return evl_ctx_recall(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("recall"))


@query("SELECT * FROM (VALUES (0, 'missing:code', NULL), (1, 'enum:kind', 2.0::DOUBLE), (2, '', 3.0::DOUBLE), (3, 'type:amount', NULL)) t(i, errors, amount)")
def fn_schema_validate(spark, sf):
    schema, values, required = files.field_schema({"fields": {"code": {"type": "string|null", "required": True}, "amount": {"type": "number"}, "kind": {"values": "kinds.values"}}, "kinds": {"values": ["a", "b"]}})
    rows = ['{"kind": "a"}', '{"code": "x", "amount": "2", "kind": "z"}', '{"code": null, "amount": 3.0}', '{"code": "x", "amount": "much"}']
    d = spark.createDataFrame(list(enumerate(rows)), "i int, t string").withColumn("p", files.parsed(F.col("t"), schema, values, required))
    return d.select("i", F.array_join("p.errors", ";").alias("errors"), F.get_json_object("t", "$.amount").try_cast("double").alias("amount"))


@query(f"{WITH} SELECT contract_id, count(*) AS n, CAST(sum(planned) AS DECIMAL(38,2)) AS planned FROM plans WHERE state IN ('draft', 'confirmed', 'partial') AND planned_date < DATE '{AS_OF}' AND actual IS NULL GROUP BY contract_id")
def cr_overdue(spark, sf):
    late = plans(spark, sf).where(F.col("state").isin("draft", "confirmed", "partial") & (F.col("planned_date") < F.lit(AS_OF).cast("date")) & F.col("actual").isNull())
    return late.groupBy("contract_id").agg(F.count("*").alias("n"), F.sum("planned").cast("decimal(38,2)").alias("planned"))


@query("""WITH x AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'success' WHEN nxt IS NULL OR epoch(nxt) - epoch(ts) >= 900 THEN 'resubmitted' ELSE 'running' END AS status FROM x""")
def sm_extract(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    dead = nxt.isNull() | (F.unix_micros(nxt) - F.unix_micros("ts") >= 900_000_000)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").when(dead, "resubmitted").otherwise("running")
    return e.select("user_id", "event_id", status.alias("status"))


def machine_sql(moves, start: str) -> str:
    """The transition log by SQL: each user's actions, one after another."""
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in machines.ACTIONS.items())
    step = " ".join(f"WHEN {{0}} = '{s}' AND e.action = '{a}' THEN '{t}'" for (s, a), t in moves.items())
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type {named} END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
l AS (SELECT user_id, event_id, action, r, '{start}' AS before, CASE {step.format(f"'{start}'")} ELSE '{start}' END AS after FROM e WHERE r = 1
UNION ALL SELECT e.user_id, e.event_id, e.action, e.r, l.after, CASE {step.format('l.after')} ELSE l.after END FROM l JOIN e ON e.user_id = l.user_id AND e.r = l.r + 1)
SELECT user_id, event_id, action, before, after FROM l"""


@query(machine_sql(machines.REVIEW, "none"))
def sm_review(spark, sf):
    return machines.finished(machines.transitions(machines.actions(machines.event_stream(spark, sf)), machines.REVIEW, "none"), "review")


@query(machine_sql(machines.CONTRACT, "draft"))
def sm_log(spark, sf):
    return machines.finished(machines.transitions(machines.actions(machines.event_stream(spark, sf)), machines.CONTRACT, "draft"), "contract")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_daily_stream(spark, sf):
    return machines.final_counts(machines.daily_counts(machines.event_stream(spark, sf)), "daily")

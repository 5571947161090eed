"""Registered queries on joins, checks, decisions, schedules and evaluation, and their SQL; importing adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewright.functions import checks, fields, money, text
from clausewright.plans.catalogue import SUMMARY, WITH, query, summary
from clausewright.sources.tables import contracts, plans, table

GLOSSARY = {"teh ": "the ", "adn ": "and ", "recieve": "receive"}
MOVES = [("approval", "sign", "seal"), ("seal", "archive", "archived"), ("approval", "reject", "draft"), ("draft", "void", "void"), ("approval", "void", "void"), ("seal", "void", "void"), ("archived", "void", "void")]


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(f"{WITH} SELECT p.contract_id, p.line, p.part, p.partner_b, p.planned, c.code, c.type, c.state AS contract_state, s_name AS partner_b_name FROM plans p JOIN contracts c ON c.id = p.contract_id LEFT JOIN supplier ON s_suppkey = p.partner_b")
def jn_plan(spark, sf):
    c = contracts(spark, sf).select(F.col("id").alias("contract_id"), "code", "type", F.col("state").alias("contract_state"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("partner_b"), F.col("s_name").alias("partner_b_name"))
    return plans(spark, sf).select("contract_id", "line", "part", "partner_b", "planned").join(c, "contract_id").join(s, "partner_b", "left")


@query("SELECT DISTINCT trim(s_name, ' ') AS name FROM supplier WHERE trim(s_name, ' ') <> '' AND trim(s_name, ' ') NOT IN (SELECT trim(c_name, ' ') FROM customer WHERE c_name IS NOT NULL)")
def jn_entity_link(spark, sf):
    known = table(spark, sf, "customer").select(F.trim("c_name").alias("name"))
    return table(spark, sf, "supplier").select(F.trim("s_name").alias("name")).where("name <> ''").join(known, "name", "left_anti").distinct()


@query("SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'missing' END AS note FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_example(spark, sf):
    found = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    return docs(spark, sf).select("doc_id").join(found, "doc_id", "left").select("doc_id", "quality", F.when(F.col("there").isNull(), "missing").alias("note"))


@query("SELECT doc_id, CAST(list_position(list_transform(string_split(text, chr(10)), lambda x: contains(x, 'the')), true) AS BIGINT) AS line FROM documents")
def jn_contain(spark, sf):
    hits = F.transform(F.split("text", "\n"), lambda x: F.contains(x, F.lit("the")))
    at = F.array_position(hits, F.lit(True))
    return docs(spark, sf).select("doc_id", F.when(at > 0, at).alias("line"))


@query(f"{WITH} SELECT type, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM contracts GROUP BY type")
def ag_graph_bar(spark, sf):
    return contracts(spark, sf).groupBy("type").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))


@query(f"{WITH} SELECT state, type, partner_a, count(*) AS n FROM contracts GROUP BY GROUPING SETS ((state), (type), (partner_a))")
def ag_group_filters(spark, sf):
    return contracts(spark, sf).groupingSets([["state"], ["type"], ["partner_a"]], "state", "type", "partner_a").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT c_custkey AS party, count(id) AS n FROM customer LEFT JOIN contracts ON partner_a = c_custkey GROUP BY 1")
def ag_signatory_count(spark, sf):
    n = contracts(spark, sf).groupBy(F.col("partner_a").alias("party")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("party")).join(n, "party", "left").select("party", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1")
def ag_best_chunk(spark, sf):
    best = F.max(F.struct("value", (-F.col("event_id")).alias("k")))
    return table(spark, sf, "events").where("value IS NOT NULL").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.value", (-F.col("b.k")).alias("event_id"))


@query("""WITH b AS (SELECT user_id, event_id, value / 400 AS conf FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conf > 0.5, conf, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS total, count(*) FILTER (WHERE conf < 0.85) OVER (PARTITION BY user_id) AS low FROM b)
SELECT user_id, event_id, r, round(low / total, 3) AS low_ratio FROM r WHERE r <= 20""")
def ag_ocr_conf(spark, sf):
    b = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 400).alias("conf"))
    rank = Window.partitionBy("user_id").orderBy(F.col("conf") > 0.5, "conf", "event_id")
    low = b.groupBy("user_id").agg(F.round(F.count_if(F.col("conf") < 0.85) / F.count("*"), 3).alias("low_ratio"))
    worst = b.withColumn("r", F.row_number().over(rank)).where("r <= 20").select("user_id", "event_id", "r")
    return worst.join(low, "user_id")


@query("SELECT event_id, CASE WHEN value / 400 <= 0.5 THEN 'dropped' WHEN value / 400 < 0.85 THEN 'low' ELSE 'ok' END AS tier FROM events")
def fn_conf_tier(spark, sf):
    return table(spark, sf, "events").select("event_id", checks.conf_tier(F.col("value") / 400).alias("tier"))


@query(f"{WITH} SELECT contract_id, bool_or(state = 'paid') AS any_paid, bool_and(state = 'paid') AS all_paid FROM plans GROUP BY contract_id")
def ag_bool_any(spark, sf):
    paid = F.col("state") == "paid"
    return plans(spark, sf).groupBy("contract_id").agg(F.bool_or(paid).alias("any_paid"), F.bool_and(paid).alias("all_paid"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS n FROM documents")
def ag_collect_set(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))).cast("long").alias("n"))


@query(f"{WITH} SELECT id, 'C-' || strftime(date_signed, '%Y%m%d') || '-' || lpad(CAST(row_number() OVER (PARTITION BY date_signed ORDER BY id) AS VARCHAR), 4, '0') AS next_code FROM contracts")
def wn_next_code(spark, sf):
    n = F.row_number().over(Window.partitionBy("date_signed").orderBy("id")).cast("string")
    return contracts(spark, sf).select("id", F.concat(F.lit("C-"), F.date_format("date_signed", "yyyyMMdd"), F.lit("-"), F.lpad(n, 4, "0")).alias("next_code"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'purchase', value DESC, event_id) AS r FROM events) WHERE r <= 3""")
def tk_backfill(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.col("event_type") != "purchase", F.desc_nulls_last("value"), "event_id")
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id", "event_type")


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def set_union_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("name")))


TOKENS = r"list_filter(regexp_split_to_array({}, '[，。；：、 \t\n\r,;:]+'), lambda x: length(x) >= 2)"
TURNS = f"""WITH t AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
p AS (SELECT conv_id, turn, list_distinct({TOKENS.format("q")}) AS q, list_distinct({TOKENS.format("a")}) AS a FROM t WHERE q IS NOT NULL AND a IS NOT NULL)"""


def turns(spark, sf):
    """The words of each turn and of the next one, as question and answer."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("q"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("a"))
    words = lambda c: F.array_distinct(F.filter(text.tokens(F.col(c)), lambda x: F.length(x) >= 2))
    return t.dropna(subset=["q", "a"]).select("conv_id", "turn", words("q").alias("q"), words("a").alias("a"))


@query(f"{TURNS} SELECT conv_id, turn, CAST(len(list_intersect(q, a)) AS BIGINT) AS n FROM p")
def set_intersect(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", checks.overlap(F.col("q"), F.col("a")).cast("long").alias("n"))


@query(f"{TURNS} SELECT conv_id, turn, CAST(len(q) - len(list_intersect(q, a)) AS BIGINT) AS n FROM p")
def set_except(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.size(F.array_except("q", "a")).cast("long").alias("n"))


@query(f"{TURNS} SELECT conv_id, turn, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, a)) / len(q), 4) ELSE 0.0 END AS score FROM p")
def evl_ctx_precision(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", checks.share(checks.overlap(F.col("q"), F.col("a")), F.size("q")).alias("score"))


@query(f"{TURNS} SELECT conv_id, turn, CASE WHEN greatest(len(q), len(a)) > 0 THEN round(len(list_intersect(q, a)) / greatest(len(q), len(a)), 4) ELSE 0.0 END AS score FROM p")
def evl_relevancy(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", checks.share(checks.overlap(F.col("q"), F.col("a")), F.greatest(F.size("q"), F.size("a"))).alias("score"))


@query("SELECT doc_id, coalesce(nullif(lang, ''), 'und') AS lang FROM documents")
def set_fill_missing(spark, sf):
    return docs(spark, sf).select("doc_id", F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")).alias("lang"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: length(trim(x, ' ')) >= 10)) AS BIGINT) AS n FROM documents")
def tx_split_paras(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<tr[^>]*>.*?</tr>')) AS BIGINT) AS n_rows, CAST(len(regexp_extract_all(html, '(?is)<t[dh][^>]*>.*?</t[dh]>')) AS BIGINT) AS n_cells FROM pages")
def tx_html_rows(spark, sf):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), 0)).cast("long")
    return table(spark, sf, "pages").select("page_id", n("(?is)<tr[^>]*>.*?</tr>").alias("n_rows"), n("(?is)<t[dh][^>]*>.*?</t[dh]>").alias("n_cells"))


@query("SELECT doc_id, replace(replace(replace(text, 'teh ', 'the '), 'adn ', 'and '), 'recieve', 'receive') AS text FROM documents")
def tx_glossary(spark, sf):
    return docs(spark, sf).select("doc_id", checks.corrected(F.col("text"), GLOSSARY).alias("text"))


@query("SELECT doc_id, left(text, 3000) AS head FROM documents")
def tx_slice_window(spark, sf):
    return docs(spark, sf).select("doc_id", F.left("text", F.lit(3000)).alias("head"))


@query(f"{WITH} SELECT id, concat_ws(chr(10), 'Contract ' || code, 'Type: ' || type, 'Amount: ' || CAST(amount AS VARCHAR), 'Signed: ' || CAST(date_signed AS VARCHAR)) AS text FROM contracts")
def tx_synth_doc(spark, sf):
    lines = [F.concat(F.lit(a), F.col(c).cast("string")) for a, c in (("Contract ", "code"), ("Type: ", "type"), ("Amount: ", "amount"), ("Signed: ", "date_signed"))]
    return contracts(spark, sf).select("id", F.concat_ws("\n", *lines).alias("text"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, CASE WHEN length(replace(p_name, ' ', '')) = 0 THEN CASE WHEN length(replace(p_type, ' ', '')) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(replace(p_name, ' ', ''), replace(p_type, ' ', '')) / length(replace(p_name, ' ', '')) END AS cer FROM part")
def fn_cer(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"), text.cer(F.col("p_name"), F.col("p_type")).alias("cer"))


PAGES = """p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars, least(1.0, (length(html) - length(replace(html, '<img', ''))) / 4 / 5.0) AS images FROM pages),
k AS (SELECT *, CASE WHEN images >= 0.6 THEN CASE WHEN chars >= 50 THEN 'text_layered' ELSE 'scanned' END ELSE 'text' END AS kind FROM p)"""


def probed(spark, sf):
    """Characters of a page, and a ratio of images: its number of images in fifths."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("chars"), F.least(F.lit(1.0), text.count_of(F.col("html"), "<img") / 5).alias("images"))
    return p.withColumn("kind", checks.page_class(F.col("chars"), F.col("images")))


@query(f"WITH {PAGES} SELECT page_id, kind, (chars < 30 OR (kind = 'text_layered' AND chars < 100)) AS suspect FROM k")
def fn_page_class(spark, sf):
    return probed(spark, sf).select("page_id", "kind", checks.page_suspect(F.col("chars"), F.lit(1.0), F.col("kind") == "text_layered").alias("suspect"))


@query(f"WITH {PAGES} SELECT host, CASE WHEN NOT bool_or(kind = 'scanned') THEN 'text' WHEN bool_and(kind = 'scanned') THEN 'scanned' ELSE 'mixed' END AS class FROM k GROUP BY host")
def fn_doc_class(spark, sf):
    return probed(spark, sf).groupBy("host").agg(checks.doc_class(F.col("kind")).alias("class"))


def given(spark, rows, f):
    return spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", f(F.col("t")).alias("v"))


@query("""SELECT i, kind, CAST(conf AS DOUBLE) AS conf, method, review FROM (VALUES (0, 'a', 0.6, 'rule_fallback', false), (1, 'a', 0.97, 'llm', false), (2, 'a', 0.6325, 'ensemble', false), (3, 'b', 0.51, 'conflict', true), (4, 'b', 0.8, 'llm', false)) t(i, kind, conf, method, review)""")
def cl_fuse(spark, sf):
    rows = [(0, "a", 0.6, "b", 0.3, True), (1, "a", 0.6, "a", 0.92, False), (2, "a", 0.6, "a", 0.45, False), (3, "a", 0.5, "b", 0.6, False), (4, "a", 0.9, "b", 0.8, False)]
    d = spark.createDataFrame(rows, "i int, r string, rc double, m string, mc double, failed boolean")
    d = d.withColumn("f", checks.fuse(*map(F.col, ("r", "rc", "m", "mc", "failed"))))
    return d.select("i", F.col("f.type").alias("kind"), "f.conf", "f.method", checks.needs_review((F.col("r") == F.col("m")) | F.col("failed"), F.col("f.conf")).alias("review"))


GRADED = f"""{WITH}, {SUMMARY}, g AS (SELECT id, type IS NULL OR amount IS NULL AS fatal, amount <= 0 OR amount > 10000000000 AS insane, date_signed > date_end AS disorder,
plan_count > 0 AND abs(CAST(planned_total AS DOUBLE) - CAST(amount AS DOUBLE)) > greatest(0.01, abs(CAST(amount AS DOUBLE)) * 0.01) AS off, overdue_count > 0 AS late FROM summary)"""


def graded(spark, sf):
    amount, planned = F.col("amount").cast("double"), F.col("planned_total").cast("double")
    off = (F.col("plan_count") > 0) & (F.abs(planned - amount) > F.greatest(F.lit(0.01), F.abs(amount) * 0.01))
    return summary(spark, sf).select("id", (F.size(checks.missing("type", "amount")) > 0).alias("fatal"), ((amount <= 0) | (amount > 1e10)).alias("insane"), (F.col("date_signed") > F.col("date_end")).alias("disorder"), off.alias("off"), (F.col("overdue_count") > 0).alias("late"))


@query(f"{GRADED} SELECT id, round(greatest(0.01, least(0.99, 0.35 + 0.35 * CASE WHEN off THEN 0 ELSE 1 END + CASE WHEN insane THEN 0.0 ELSE 0.3 END - 0.15 * CAST(insane AS INT) - 0.1 * CAST(fatal AS INT) - 0.05 * (CAST(disorder AS INT) + CAST(late AS INT)))), 3)::DOUBLE AS conf FROM g")
def dq_confidence(spark, sf):
    n = lambda c: F.col(c).cast("int")
    return graded(spark, sf).select("id", checks.confidence(F.lit(1.0), 1 - n("off"), n("insane"), n("fatal"), n("disorder") + n("late")).alias("conf"))


@query(f"{GRADED} SELECT id, concat_ws(';', CASE WHEN fatal THEN 'fatal' END, CASE WHEN insane THEN 'amount' END, CASE WHEN disorder THEN 'dates' END, CASE WHEN off THEN 'schedule' END) AS reasons, (fatal OR insane OR disorder OR off) AS needs_review FROM g")
def gate_quality(spark, sf):
    r = checks.reasons(*[(F.col(c), s) for c, s in (("fatal", "fatal"), ("insane", "amount"), ("disorder", "dates"), ("off", "schedule"))])
    return graded(spark, sf).select("id", F.array_join(r, ";").alias("reasons"), (F.size(r) > 0).alias("needs_review"))


@query(f"{WITH}, {SUMMARY} SELECT id, CAST(planned_total - amount AS DOUBLE) AS diff, abs(planned_total - amount) > 0.01 AS warn FROM summary WHERE plan_count > 0")
def dq_plan_diff(spark, sf):
    diff = F.col("planned_total") - F.col("amount")
    return summary(spark, sf).where("plan_count > 0").select("id", diff.cast("double").alias("diff"), (F.abs(diff) > 0.01).alias("warn"))


MATCHED = f"{WITH}, s AS (SELECT contract_id, sum(planned) AS said, min(planned_date) AS first FROM plans GROUP BY 1), m AS (SELECT c.id, c.type, CASE WHEN c.amount IS NULL AND said IS NULL THEN true WHEN c.amount IS NULL OR said IS NULL THEN false WHEN c.amount = 0 THEN said = 0 ELSE abs(CAST(said AS DOUBLE) - CAST(c.amount AS DOUBLE)) / abs(CAST(c.amount AS DOUBLE)) < 0.02 END AS amount_ok, coalesce(c.date_signed = first, false) AS date_ok FROM contracts c LEFT JOIN s ON c.id = s.contract_id)"


def matched(spark, sf):
    """Contracts' amounts and dates, the gold, against what their plans say."""
    s = plans(spark, sf).groupBy(F.col("contract_id").alias("id")).agg(F.sum("planned").cast("double").alias("said"), F.min("planned_date").alias("first"))
    c = contracts(spark, sf).select("id", "type", F.col("amount").cast("double").alias("amount"), "date_signed").join(s, "id", "left")
    return c.select("id", "type", checks.amounts_match(F.col("amount"), F.col("said")).alias("amount_ok"), F.coalesce(F.col("date_signed") == F.col("first"), F.lit(False)).alias("date_ok"))


@query(f"{MATCHED} SELECT id, amount_ok, date_ok FROM m")
def evl_match(spark, sf):
    return matched(spark, sf).select("id", "amount_ok", "date_ok")


@query(f"{MATCHED} SELECT type, round(avg(CAST(amount_ok AS INT)), 4) AS amount_accuracy, round(avg(CAST(date_ok AS INT)), 4) AS date_accuracy FROM m GROUP BY type")
def evl_compare(spark, sf):
    return matched(spark, sf).groupBy("type").agg(*[F.round(F.avg(F.col(f"{c}_ok").cast("int")), 4).alias(f"{c}_accuracy") for c in ("amount", "date")])


@query(f"{WITH} SELECT id, action, next FROM contracts JOIN (VALUES {', '.join(map(str, MOVES))}) m(state, action, next) USING (state)")
def sm_contract(spark, sf):
    moves = spark.createDataFrame(MOVES, "state string, action string, next string")  # seven rows
    return contracts(spark, sf).select("id", "state").join(F.broadcast(moves), "state").select("id", "action", "next")


@query(f"{WITH} SELECT contract_id, line, part, partner_b, planned, CASE WHEN state = 'cancelled' THEN state ELSE 'paid' END AS state, CASE WHEN state = 'cancelled' THEN actual ELSE coalesce(actual, planned) END AS actual FROM plans")
def sm_plan(spark, sf):
    gone = F.col("state") == "cancelled"
    return plans(spark, sf).select("contract_id", "line", "part", "partner_b", "planned", F.when(gone, F.col("state")).otherwise("paid").alias("state"), F.when(gone, F.col("actual")).otherwise(F.coalesce("actual", "planned")).alias("actual"))


@query("SELECT user_id, coalesce(min(event_id) FILTER (WHERE event_type <> 'error'), max(event_id)) AS attempt FROM events GROUP BY user_id")
def ex_loop(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("event_type") != "error", F.col("event_id"))), F.max("event_id")).alias("attempt"))

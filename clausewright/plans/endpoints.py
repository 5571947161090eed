"""Registered queries of the service's and the ledger's smaller operations, and their SQL; importing adds them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewright.operators import clauses, elements, ledger
from clausewright.plans.catalogue import NEAREST, SUMMARY, WITH, nearest, query, summary
from clausewright.plans.documents import LABELS
from clausewright.plans.review import MATCHED, docs, matched
from clausewright.plans.texts import texts
from clausewright.sources.tables import contracts, plans, table

CHARS = "length(regexp_replace(html, '<[^>]*>', '', 'g'))"
IMAGES = "(length(html) - length(replace(html, '<img', ''))) // 4"
HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
# How a contract's states are shown.
STATE_LABELS = {"draft": "草拟", "approval": "审批中", "seal": "已用印", "archived": "已归档", "void": "已作废"}
PREFIXES = {"sale": "XS", "purchase": "CG"}
DROPPED = 35


@query(f"{WITH}, b AS (SELECT contract_id, min(partner_b) AS partner_b FROM plans GROUP BY 1) SELECT c.id, c_name AS partner_a_name, s_name AS partner_b_name FROM contracts c LEFT JOIN b ON b.contract_id = c.id LEFT JOIN customer ON c_custkey = c.partner_a LEFT JOIN supplier ON s_suppkey = b.partner_b")
def jn_partner(spark, sf):
    b = plans(spark, sf).groupBy(F.col("contract_id").alias("id")).agg(F.min("partner_b").alias("partner_b"))
    c = contracts(spark, sf).select("id", "partner_a").join(b, "id", "left")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("partner_a"), F.col("c_name").alias("partner_a_name"))
    others = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("partner_b"), F.col("s_name").alias("partner_b_name"))
    return c.join(names, "partner_a", "left").join(others, "partner_b", "left").select("id", "partner_a_name", "partner_b_name")


def cases(column: str, labels: dict[str, str]) -> str:
    return f"coalesce(CASE {column} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in labels.items())} ELSE {column} END, '')"


def labelled(column: str, labels: dict[str, str]):
    """The label of a coded value, or the value itself where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(column)], F.col(column))


def listed(spark, sf):
    """What the list sheet shows of each contract; even ids have no start, ids that 5 divides no currency."""
    s = summary(spark, sf).join(jn_partner(spark, sf), "id")
    return s.select(
        "*", F.concat_ws(" ", "type", "code").alias("name"), labelled("type", LABELS).alias("type_label"), labelled("state", STATE_LABELS).alias("state_label"),
        F.when(F.col("id") % 2 == 1, F.date_add("date_signed", 1)).alias("date_start"), F.when(F.col("id") % 5 != 0, "CNY").alias("currency"), (F.col("id") % 4 != 0).alias("is_ai"),
    )


@query(f"""{WITH}, {SUMMARY}, b AS (SELECT contract_id, min(partner_b) AS partner_b FROM plans GROUP BY 1)
SELECT coalesce(code, '/') AS "合同编号", concat_ws(' ', type, code) AS "合同名称", {cases('type', LABELS)} AS "类型", {cases('state', STATE_LABELS)} AS "状态",
  coalesce(c_name, '') AS "甲方", coalesce(s_name, '') AS "乙方", coalesce(CAST(date_signed AS VARCHAR), '') AS "签订日期", CASE WHEN id % 2 = 1 THEN coalesce(CAST(date_signed + 1 AS VARCHAR), '') ELSE '' END AS "生效日期",
  coalesce(CAST(date_end AS VARCHAR), '') AS "到期日期", coalesce(amount, 0) AS "合同金额", CASE WHEN id % 5 <> 0 THEN 'CNY' ELSE '' END AS "币种", planned_total AS "计划总额", paid_total AS "已完成", remaining_total AS "剩余",
  plan_count AS "付款计划数", overdue_count AS "逾期数", CASE WHEN id % 4 <> 0 THEN '是' ELSE '否' END AS "AI 来源"
FROM summary LEFT JOIN b ON contract_id = id LEFT JOIN customer ON c_custkey = partner_a LEFT JOIN supplier ON s_suppkey = b.partner_b""")
def snk_excel(spark, sf):
    """The list sheet of the exported workbook; ag_type_summary is its second, ledger.write_sheets() writes both."""
    return ledger.sheet(listed(spark, sf))


@query("SELECT doc_id, lang, length(text) AS chars FROM documents WHERE lang = 'de'")
def vx_lookup(spark, sf):
    return docs(spark, sf).where("lang = 'de'").select("doc_id", "lang", F.length("text").cast("long").alias("chars"))


@query("SELECT label, count(*) AS n, min(len(embedding)) AS dim, min(len(embedding)) = max(len(embedding)) AS one_dim FROM embeddings GROUP BY label")
def vx_meta(spark, sf):
    e = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dim"), F.max(F.size("embedding")).alias("most"))
    return e.select("label", "n", "dim", (F.col("dim") == F.col("most")).alias("one_dim"))


@query("SELECT label, count(*) FILTER (WHERE label <> (SELECT min(label) FROM embeddings)) AS n FROM embeddings GROUP BY label")
def vx_reset(spark, sf):
    """The collections' sizes after the first by name has been cleared."""
    n = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    first = n.agg(F.min("label").alias("first"))  # one row
    return n.join(F.broadcast(first)).select("label", F.when(F.col("label") == F.col("first"), 0).otherwise(F.col("n")).alias("n"))


@texts("SELECT id, CASE WHEN id % 9 = 0 THEN 'missing:type' END AS error, CASE WHEN id % 9 <> 0 THEN CAST(id AS VARCHAR) || ':0000' END AS chunk_id FROM f")
def vx_ingest(f):
    """Chunks of examples; one that lacks a required field gives an error row, and the others go on."""
    kind = F.when(F.col("id") % 9 != 0, F.col("title"))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(v), F.lit("")) == "", n) for n, v in (("id", F.col("id").cast("string")), ("type", kind), ("text", F.col("text")))]))
    d = f.select("id", F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))).alias("error"), "text")
    good = clauses.chunk_rows(d.where("error IS NULL"), "id").select("id", F.lit(None).cast("string").alias("error"), "chunk_id")
    return good.unionByName(d.where("error IS NOT NULL").select("id", "error", F.lit(None).cast("string").alias("chunk_id")))


@texts("SELECT id, CASE WHEN id % 11 = 0 THEN 'TEXT_TOO_SHORT' END AS error_code, CASE WHEN id % 11 = 0 THEN 0 ELSE 4 END AS clauses FROM f")
def api_segment(f):
    t = F.when(F.col("id") % 11 == 0, "短").otherwise(F.col("text"))
    error = F.when(F.length(F.trim(t)) < elements.LEAST_TEXT, "TEXT_TOO_SHORT")
    return f.select("id", error.alias("error_code"), F.when(error.isNull(), F.size(clauses.clauses(t))).otherwise(0).alias("clauses"))


@query(f"WITH {NEAREST} SELECT query_id, vec_id, sim, left(text, 300) AS excerpt FROM n LEFT JOIN documents ON doc_id = vec_id WHERE r <= 5")
def api_vec_search(spark, sf):
    texts_ = docs(spark, sf).select(F.col("doc_id").alias("vec_id"), F.left("text", F.lit(300)).alias("excerpt"))
    return nearest(spark, sf, 5).select("query_id", "vec_id", "sim").join(texts_, "vec_id", "left").select("query_id", "vec_id", "sim", "excerpt")


@query(f"{WITH} SELECT 'contracts' AS part, count(*) > 0 AS ready FROM contracts UNION ALL SELECT 'plans', count(*) > 0 FROM plans UNION ALL SELECT 'vectors', count(*) > 0 FROM embeddings")
def api_health(spark, sf):
    ready = lambda name, df: df.agg((F.count("*") > 0).alias("ready")).select(F.lit(name).alias("part"), "ready")
    return ready("contracts", contracts(spark, sf)).unionByName(ready("plans", plans(spark, sf))).unionByName(ready("vectors", table(spark, sf, "embeddings")))


@query(f"{WITH} SELECT partner_a AS person, id, code FROM contracts WHERE partner_a % 50 = 7")
def ld_signatory_contracts(spark, sf):
    return contracts(spark, sf).where("partner_a % 50 = 7").select(F.col("partner_a").alias("person"), "id", "code")


@query(f"{WITH} SELECT id, CASE type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in PREFIXES.items())} ELSE 'HT' END || '-' || lpad(CAST(row_number() OVER (PARTITION BY type, date_signed ORDER BY id) AS VARCHAR), 4, '0') AS code FROM contracts")
def ld_code_config(spark, sf):
    """Codes by the configured prefix of a type, else by the common one, numbered by type and day."""
    prefix = F.coalesce(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])[F.col("type")], F.lit("HT"))
    n = F.row_number().over(Window.partitionBy("type", "date_signed").orderBy("id"))
    return contracts(spark, sf).select("id", F.concat(prefix, F.lit("-"), F.lpad(n.cast("string"), 4, "0")).alias("code"))


@query(f"{WITH}, k AS (SELECT id, 'K' || CAST(id % 1000 AS VARCHAR) AS code, row_number() OVER (PARTITION BY id % 1000 ORDER BY id) AS r FROM contracts) SELECT id, CASE WHEN r = 1 THEN code END AS code, CASE WHEN r = 1 THEN 1 ELSE 2 END AS attempts FROM k")
def st_retry_tx(spark, sf):
    """Codes that another row holds already: the second attempt goes without the code; at most three are made."""
    c = contracts(spark, sf).select("id", F.concat(F.lit("K"), (F.col("id") % 1000).cast("string")).alias("code"))
    taken = F.row_number().over(Window.partitionBy("code").orderBy("id")) > 1
    c = c.withColumn("first", F.struct(F.col("code").alias("value"), (~taken).alias("ok")))
    done = c.withColumn("a", F.element_at(elements.attempts(F.col("first"), lambda v, n: F.struct(F.lit(None).cast("string").alias("value"), F.lit(True).alias("ok"))), -1))
    return done.select("id", F.col("a.value").alias("code"), F.col("a.attempt").alias("attempts"))


@query(f"{WITH}, x AS (SELECT id, field, v, CAST('0x' || left(md5(CAST(id AS VARCHAR) || '.' || field), 6) AS BIGINT) % 100 AS h FROM (SELECT id, 'code' AS field, code AS v FROM contracts UNION ALL SELECT id, 'type', type FROM contracts)) SELECT id, field, CASE WHEN h >= {DROPPED} THEN v END AS said FROM x")
def evl_mock(spark, sf):
    """Gold records with a share of their fields dropped, the same in every run."""
    x = contracts(spark, sf).select("id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("v")) for n in ("code", "type")])))
    h = F.conv(F.left(F.md5(F.concat(F.col("id").cast("string"), F.lit("."), "field")), F.lit(6)), 16, 10).cast("long") % 100
    return x.select("id", "field", F.when(h >= DROPPED, F.col("v")).alias("said"))


@query(f"{MATCHED} SELECT '| ' || type || ' | ' || count(*) FILTER (WHERE amount_ok) || '/' || count(*) || ' | ' || count(*) FILTER (WHERE date_ok) || '/' || count(*) || ' |' AS line FROM m GROUP BY type")
def snk_report(spark, sf):
    m = matched(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.count_if("amount_ok").alias("a"), F.count_if("date_ok").alias("d"))
    return m.where("type IS NOT NULL").select(F.format_string("| %s | %d/%d | %d/%d |", "type", "a", "n", "d", "n").alias("line"))


@query(f"SELECT page_id, {CHARS} AS chars, {IMAGES} AS images, round(CASE WHEN {CHARS} > 0 THEN length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[^a-zA-Z0-9]', '', 'g')) / {CHARS} ELSE 0 END, 4) AS readable FROM pages")
def src_pdf_probe(spark, sf):
    """A page's signals: characters, images, and the share of plain letters and digits."""
    p = table(spark, sf, "pages").select("page_id", "html", F.regexp_replace("html", "<[^>]*>", "").alias("t"))
    n = F.length("t").cast("long")
    share = F.when(n > 0, F.length(F.regexp_replace("t", "[^a-zA-Z0-9]", "")) / n).otherwise(0.0)
    return p.select("page_id", n.alias("chars"), F.expr("(length(html) - length(replace(html, '<img', ''))) div 4").alias("images"), F.round(share, 4).alias("readable"))


@query(f"SELECT {HOST} AS host, sum({CHARS})::BIGINT AS chars, sum({CHARS}) > 50 AS has_text FROM pages GROUP BY 1")
def pg_text_layer(spark, sf):
    p = table(spark, sf, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.sum(F.length(F.regexp_replace("html", "<[^>]*>", ""))).alias("chars"))
    return p.select("host", "chars", (F.col("chars") > 50).alias("has_text"))

"""Registered queries on the contracts' texts, and their SQL; importing adds them.

A text is made of each contract's own values, in forms that change with its id. The SQL states what must be found from
the values, or makes the same text and cuts it by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import checks, fields, money, text
from clausewright.operators import classify, clauses, elements
from clausewright.plans.catalogue import WITH, query
from clausewright.sources.tables import contracts, table

CAPITALS = "壹贰叁肆伍陆柒捌玖"
TITLES = {"purchase": "设备采购合同", "sale": "产品销售合同", "service": "技术服务合同", "lease": "房屋租赁合同", "other": "合作协议"}
KINDS = {"purchase": "采购合同", "sale": "销售合同", "service": "服务合同", "lease": "租赁合同"}
DISPUTES = ["提交北京仲裁委员会仲裁。", "向人民法院提起诉讼。", "经第三方调解解决。", "双方友好协商。", "另行约定。"]
FOUND = ["提交仲裁委员会仲裁", "向人民法院提起诉讼", "调解解决", "协商解决", None]
QUESTIONS = {"contract_code": "合同编号是什么？", "partner_a": "甲方是谁？", "amount": "合同金额是多少？", "dispute_resolution": "争议如何解决？"}


def by_id(n: int, values: list) -> str:
    """CASE id % n over SQL expressions."""
    return f"CASE id % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def text_of(values: list) -> list[str]:
    return ["CAST(NULL AS STRING)" if v is None else f"'{v}'" for v in values]


def made(day, money_, plain) -> str:
    """The values and texts of contracts c as SQL: day(date, style), money_(amount) and plain(amount) differ by dialect."""
    digit = lambda k: f"(1 + CAST(floor(id / {9**k}) AS BIGINT) % 9)"
    capital = lambda k: f"substr('{CAPITALS}', CAST({digit(k)} AS INT), 1)"
    title = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items()) + " END"
    heads = [f"CASE WHEN id % 2 = 0 THEN '第{n}条 ' ELSE '{n}、' END || '{name}'" for n, name in zip("一二三", ("合同标的", "付款方式", "争议解决"))]
    return f"""v AS (
  SELECT c.*, {title} AS title, 'CG-' || {day('date_signed', 4)} || '-' || lpad(CAST(id % 10000 AS VARCHAR(9)), 4, '0') AS contract_code,
    'Buyer ' || CAST(partner_a AS VARCHAR(19)) || ' 有限公司' AS party_a, 'Seller ' || CAST(id % 97 AS VARCHAR(9)) || ' 股份有限公司' AS party_b,
    {capital(0)} || '万' || {capital(1)} || '仟' || {capital(2)} || '佰' || {capital(3)} || '拾元整' AS capital,
    CAST({digit(0)} * 10000 + {digit(1)} * 1000 + {digit(2)} * 100 + {digit(3)} * 10 AS DOUBLE) AS capital_value,
    {by_id(3, [f"'合同总金额为人民币 ' || {plain('amount')} || ' 元。'", f"'合同总价：' || {money_('amount')} || ' 元。'", f"'合同总金额为人民币 ' || {plain('CAST(amount / 10000 AS DECIMAL(18,6))')} || ' 万元。'"])} AS amount_line,
    {by_id(4, [day('date_signed', k) for k in range(4)])} AS signed_text, date_signed + CAST(id % 10 AS INT) AS effective,
    10 + 10 * (id % 5) AS p1, CASE WHEN id % 4 = 3 THEN 35 ELSE 40 END AS p2, 50 - 10 * (id % 5) AS p3, 5 + id % 20 AS days,
    {by_id(5, text_of(DISPUTES))} AS dispute_text, {by_id(5, text_of(FOUND)).replace('AS STRING', 'AS VARCHAR(9)')} AS dispute,
    {', '.join(f'{h} AS head{i}' for i, h in enumerate(heads, 1))}
  FROM contracts c
), w AS (
  SELECT *, '签订后5日内支付' || CAST(p1 AS VARCHAR(9)) || '%预付款；验收合格后' || CAST(days AS VARCHAR(9)) || '个工作日内支付' || CAST(p2 AS VARCHAR(9)) || '%；剩余' || CAST(p3 AS VARCHAR(9)) || '%作为质保金，30日内付清' AS terms,
    title || chr(10) || '合同编号：' || contract_code || chr(10) || '甲方（买方）：' || party_a || chr(10) || '乙方（卖方）：' || party_b || chr(10) || '大写：' || capital || chr(10) || amount_line || chr(10)
      || '签订日期：' || signed_text || chr(10) || '履行期限自 ' || {day('effective', 0)} || '，有效期至 ' || {day('date_end', 0)} || '。' AS pre
  FROM v
), f AS (
  SELECT *, pre || chr(10) || head1 || chr(10) || '标的为设备 ' || CAST(id AS VARCHAR(19)) || '。' || chr(10) || head2 || chr(10) || terms || chr(10) || head3 || chr(10) || dispute_text AS text FROM w
)"""


STYLES = [("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy年M月d日", "%Y年%-m月%-d日"), ("yyyy/M/d", "%Y/%-m/%-d"), ("yyyy.MM.dd", "%Y.%m.%d"), ("yyyyMMdd", "%Y%m%d")]
SPARK = made(lambda d, k: f"date_format({d}, '{STYLES[k][0]}')", lambda a: f"format_number({a}, 2)", lambda a: f"CAST({a} AS STRING)")
F_SQL = f"{WITH}, " + made(lambda d, k: f"strftime({d}, '{STYLES[k][1]}')", lambda a: f"format('{{:,.2f}}', CAST({a} AS DOUBLE))", lambda a: f"CAST({a} AS VARCHAR)")


def contract_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"WITH {SPARK} SELECT * FROM f".replace("FROM contracts c", "FROM {contracts} c"), contracts=contracts(spark, sf))


def texts(sql: str):
    """Registers a query on the contracts' texts (spark, sf, f) with SQL over f."""

    def add(g):
        def run(spark, sf):
            return g(contract_texts(spark, sf))

        run.__name__ = g.__name__
        query(f"{F_SQL} {sql}")(run)
        return run

    return add


TRUTH = {
    "contract_code": "contract_code", "partner_a": "party_a", "partner_b": "party_b", "amount": "CAST(amount AS DOUBLE)", "amount_uppercase": "capital", "sign_date": "CAST(date_signed AS VARCHAR)",
    "effective_date": "CAST(effective AS VARCHAR)", "expire_date": "CAST(date_end AS VARCHAR)", "dispute_resolution": "dispute", "currency": "CASE WHEN id % 3 <> 1 THEN 'CNY' END",
}


def filling(name: str, truth: str) -> None:
    def run(f):
        return f.select("id", fields.FILLERS[name](F.col("text")).alias("v"))

    run.__name__ = f"ex_fill_{name}"
    texts(f"SELECT id, {truth} AS v FROM f")(run)


for _n, _t in TRUTH.items():
    filling(_n, _t)


def records(f: DataFrame, given: dict[str, str] | None = None) -> DataFrame:
    """id, text and the fields: null, or as the expressions in `given` say."""
    given = given or {}
    return f.select("id", "text", "date_signed", "terms", "title", *[F.expr(given.get(n, "NULL")).cast("double" if n == "amount" else "string").alias(n) for n in fields.FILLERS])


@texts("SELECT id, contract_code, CASE WHEN id % 2 = 0 THEN 'Z' ELSE party_a END AS partner_a, party_b AS partner_b, CASE WHEN id % 3 = 0 THEN 7.0 ELSE CAST(amount AS DOUBLE) END AS amount FROM f")
def ex_fill(f):
    r = records(f, {"partner_a": "CASE WHEN id % 2 = 0 THEN 'Z' END", "partner_b": "' '", "amount": "CASE WHEN id % 3 = 0 THEN 7 END"})
    return r.select("id", *[fields.filled(F.col("text"), n).alias(n) for n in ("contract_code", "partner_a", "partner_b", "amount")])


#: For each id % 12, what is wrong in a contract's record and what the report says: errors, fatal, warnings.
WRONG = [
    ({}, "", "", ""), ({"amount": "9999999"}, "evidence:amount", "", ""), ({"sign_date": "'2026-12-25'"}, "evidence:sign_date", "", "sign_after_effective"), ({"partner_b": "'某某'"}, "evidence:partner_b", "", ""),
    ({"amount": "-5"}, "amount;evidence:amount", "", ""), ({"amount": "2e10"}, "amount;evidence:amount", "", ""), ({"sign_date": "'1989年3月15日'"}, "date:sign_date;evidence:sign_date", "", ""),
    ({"sign_date": "'1996-02-30'"}, "date:sign_date;evidence:sign_date", "", "?"), ({"sign_date": "'1980-01-01'"}, "date:sign_date;evidence:sign_date", "", ""), ({"dispute_resolution": "'决斗解决'"}, "enum", "", ""),
    ({"contract_code": "NULL"}, "", "contract_code", ""), ({"expire_date": "'1989-07-01'"}, "date:expire_date;evidence:expire_date", "", "effective_after_expire"),
]
GIVEN = {"contract_code": "contract_code", "partner_a": "party_a", "partner_b": "party_b", "amount": "amount", "sign_date": "CAST(date_signed AS STRING)", "effective_date": "CAST(effective AS STRING)", "expire_date": "CAST(date_end AS STRING)", "dispute_resolution": "dispute", "currency": "'CNY'"}
FLAWED = {n: f"CASE {' '.join(f'WHEN id % 12 = {i} THEN {c[n]}' for i, (c, *_) in enumerate(WRONG) if n in c)} ELSE {e} END" if any(n in c for c, *_ in WRONG) else e for n, e in GIVEN.items()}


def reported(f: DataFrame) -> DataFrame:
    return records(f.where("id % 12 <> 7"), FLAWED).withColumn("e", fields.evidence(F.col("text"))).withColumn("r", fields.report(F.col("e"), F.lit(False)))


SAID = ", ".join(f"{by_id(12, [repr(w[k]) for w in WRONG])} AS {n}" for k, n in ((1, "errors"), (2, "fatal"), (3, "warnings")))


@texts(f"SELECT id, {SAID} FROM f WHERE id % 12 <> 7")
def dq_validate(f):
    # a signing date in other than ISO form compares as text; the SQL states only what dates of that form give
    return reported(f).select("id", *[F.array_join(f"r.{c}", ";").alias(c) for c in ("errors", "fatal", "warnings")])


@texts(f"SELECT id, concat_ws(';', nullif({by_id(12, [repr(w[2]) for w in WRONG])}, ''), nullif({by_id(12, [repr(w[3]) for w in WRONG])}, ''), nullif({by_id(12, [repr(w[1]) for w in WRONG])}, '')) AS issues, {by_id(12, [repr(w[1]) for w in WRONG])} <> '' AS retryable FROM f WHERE id % 12 <> 7")
def va_issues(f):
    return reported(f).select("id", F.array_join(F.concat("r.fatal", "r.warnings", "r.errors"), ";").alias("issues"), (F.size("r.errors") > 0).alias("retryable"))


@texts("SELECT id, id % 12 NOT IN (1, 4, 5) AS amount, id % 12 <> 3 AS partner_b, CASE WHEN id % 12 <> 10 THEN true END AS contract_code FROM f WHERE id % 12 <> 7")
def ev_fields(f):
    return reported(f).select("id", *[F.expr(f"e['{n}']").alias(n) for n in ("amount", "partner_b", "contract_code")])


@texts("SELECT id, date_signed AS v FROM f")
def fn_date_norm(f):
    return f.select("id", money.date_norm(F.concat(F.lit("签订于 "), "signed_text", F.lit(" 的合同"))).alias("v"))


@texts("SELECT id, date_signed AS v FROM f")
def fn_date_eval(f):
    return f.select("id", fields.date_eval(F.when(F.col("id") % 7 == 0, F.date_format("date_signed", "yyyyMMdd")).otherwise(F.col("signed_text"))).alias("v"))


@texts("SELECT id, CASE WHEN id % 4 IN (0, 3) OR month(date_signed) > 9 AND day(date_signed) > 9 THEN date_signed END AS v FROM f")
def fn_date_ledger(f):
    return f.select("id", fields.date_ledger(F.col("signed_text")).alias("v"))


@texts("SELECT id, capital_value AS v FROM f")
def fn_cn_amount(f):
    return f.select("id", money.cn_amount(F.concat(F.lit("人民币"), "capital")).alias("v"))


@texts("SELECT id, CAST(year(date_signed) AS INT) AS v FROM f")
def fn_cn_int(f):
    return f.select("id", checks.cn_int(F.translate(F.year("date_signed").cast("string"), "0123456789", "〇一二三四五六七八九")).alias("v"))


@texts("SELECT id, CAST(p1 AS INT) AS v FROM f")
def fn_cn_ratio(f):
    return f.select("id", checks.cn_ratio(F.concat(F.lit("合同生效后支付百分之"), F.expr(by_id(5, ["'十'", "'二十'", "'三十'", "'四十'", "'五十'"])), F.lit("预付款"))).alias("v"))


@texts("SELECT id, CAST(CASE id % 4 WHEN 0 THEN days WHEN 1 THEN days * 30 WHEN 2 THEN 0 ELSE 15 END AS INT) AS v FROM f")
def fn_time_offset(f):
    return f.select("id", checks.time_offset(F.expr(by_id(4, ["'验收合格后' || days || '个工作日内'", "days || '个月后支付'", "'签订后支付'", "'另行商定'"]))).alias("v"))


@texts(f"SELECT id, {by_id(6, ['CHR(85) || CHR(83) || CHR(68)', repr('EUR'), repr('HKD'), repr('CNY'), repr('CNY'), 'NULL'])} AS v FROM f")
def fn_currency_guess(f):
    return f.select("id", fields.currency_of(F.expr(by_id(6, ["amount || '美元'", "'欧元' || amount", "'港币' || amount || '元'", "'人民币' || amount", "amount || '美元折合人民币'", "'面议'"]))).alias("v"))


@texts("SELECT id, CASE WHEN id % 3 = 2 THEN 0.0 ELSE CAST(amount AS DOUBLE) END AS v FROM f")
def fn_amount_loose(f):
    said = F.expr(by_id(3, ["CAST(CAST(amount / 10000 AS DECIMAL(18,6)) AS STRING) || ' 万元'", "'￥' || format_number(amount, 2)", "'面议'"]))
    return f.select("id", F.round(money.amount_loose(said), 2).alias("v"))


@texts("""SELECT id, CASE WHEN id % 4 <> 3 THEN '{"a": ' || CAST(id AS VARCHAR) || '}' END AS v FROM f""")
def fn_json_tolerant(f):
    one = "'{\"a\": ' || id || '}'"
    return f.select("id", checks.json_part(F.expr(by_id(4, [f"'```json\\n' || {one} || '\\n```'", one, f"'so: ' || {one} || ' .'", "'none ' || id"]))).alias("v"))


@texts("""SELECT id, label, ratio, days FROM (SELECT id, 'prepayment' AS label, p1 / 100 AS ratio, 5 AS days FROM f UNION ALL SELECT id, 'on_completion', p2 / 100, CAST(days AS INT) FROM f UNION ALL SELECT id, 'final', p3 / 100, 30 FROM f)""")
def ps_parse(f):
    return f.select("id", F.inline(checks.payment_nodes(F.regexp_extract("text", "付款方式\n([^\n]*)", 1)))).select("id", "label", "ratio", "days")


@texts("""SELECT id, i, name, milestone, percent, offset_days FROM (
SELECT id, 0 AS i, '第 1 期 · 预付款' AS name, 'prepayment' AS milestone, p1 / 100 AS percent, 5 AS offset_days FROM f UNION ALL
SELECT id, 1, '第 2 期 · 验收款', 'on_completion', p2 / 100, CAST(days AS INT) FROM f UNION ALL SELECT id, 2, '第 3 期 · 尾款', 'final', p3 / 100, 30 FROM f)""")
def ps_ledger_parse(f):
    return f.select("id", F.posexplode(elements.milestones(F.col("terms"))).alias("i", "m")).select("id", "i", "m.*")


@texts("SELECT id, round((p1 + p2 + p3) / 100, 4) AS total, id % 4 = 3 AS warn FROM f")
def dq_pct_total(f):
    total = F.round(F.aggregate(checks.payment_nodes(F.col("terms")), F.lit(0.0), lambda a, x: a + F.coalesce(x["ratio"], F.lit(0.0))), 4)
    return f.select("id", total.alias("total"), (F.abs(total - 1) > 0.02).alias("warn"))


@texts("SELECT id, CASE WHEN id % 3 = 0 THEN 12 ELSE 4 END AS n, CAST(CASE WHEN id % 3 = 0 THEN 1000 + id % 9000 ELSE 3 * (1000 + id % 9000) END AS DOUBLE) AS amount FROM f WHERE id % 3 <> 2")
def ps_rent(f):
    rent = F.expr(by_id(3, ["'月租金' || (1000 + id % 9000) || '元，按月支付'", "'年租金 ' || format_number(12 * (1000 + id % 9000), 0) || ' 元，按季度支付'", "'无'"]))
    return f.select("id", checks.rent_parts(rent).alias("r")).where("r IS NOT NULL").select("id", "r.n", "r.amount")


@texts("SELECT id, '甲方支付货款，共' || CAST(amount AS VARCHAR) || '元（含税）' AS v FROM f")
def tx_normalize_clause(f):
    return f.select("id", clauses.normalised_clause(F.expr("'甲方 支付货款,共' || amount || '元(含税)  '")).alias("v"))


@texts("SELECT id, '签订本合同' || CAST(id AS VARCHAR) || '。' || chr(10) || '甲方：' || party_a || chr(10) || '（一）甲乙' AS v FROM f")
def tx_reflow(f):
    return f.select("id", clauses.reflow(F.expr("'签订\\n本合同' || id || '。\\n甲方：' || party_a || '\\n（一）甲\\n乙'")).alias("v"))


@texts(f"SELECT id, {by_id(5, [repr(x) for x in ('arbitration', 'litigation', 'negotiation', 'negotiation', 'negotiation')])} AS v FROM f")
def prj_dispute_map(f):
    found = fields.one_of(F.col("dispute_text"), [("仲裁", "arbitration"), ("法院|诉讼|起诉", "litigation"), ("协商|调解", "negotiation")])
    return f.select("id", F.coalesce(found, F.lit("negotiation")).alias("v"))


@texts("SELECT id, id % 3 <> 2 AS ok FROM f")
def evl_fuzzy(f):
    return f.select("id", fields.fuzzy_match(F.col("party_a"), F.expr(by_id(3, ["replace(lower(party_a), ' ', '')", "'致 ' || party_a || ' 的函'", "'某某集团'"]))).alias("ok"))


@texts(f"SELECT id, CASE type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in KINDS.items())} END AS type, 'preset' AS method FROM f WHERE id % 2 = 0 AND type <> 'other' UNION ALL SELECT id, CASE type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in KINDS.items())} END, 'llm' FROM f WHERE id % 2 = 1 AND type <> 'other'")
def cl_run(f):
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("type")]
    said = F.when(F.col("id") % 2 == 1, F.concat(F.lit('{"type": "'), kind, F.lit('", "confidence": 0.9}')))
    d = f.where("type <> 'other'").select(F.col("id").alias("doc_id"), "title", "text", said.alias("model"), F.lit(None).cast("string").alias("arb_type"), F.lit(None).cast("double").alias("arb_conf"), F.when(F.col("id") % 2 == 0, kind).alias("preset"))
    return classify.classify(d).select(F.col("doc_id").alias("id"), "type", "method")


@texts(f"SELECT id, CASE type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in KINDS.items())} END AS type FROM f WHERE type <> 'other'")
def cl_title(f):
    return f.where("type <> 'other'").select("id", classify.rule(F.col("title"), F.lit(""))["type"].alias("type"))


MARKS = "CASE WHEN id % 2 = 0 THEN '第{0}条' ELSE '{0}' END"


@texts(f"""SELECT id, CAST(strpos(text, h) - 1 AS INT) AS start, CAST(strpos(text, h) - 1 + length(m) AS INT) AS "end", m AS marker FROM (
{' UNION ALL '.join(f"SELECT id, text, head{i} AS h, {MARKS.format(n)} AS m FROM f" for i, n in enumerate('一二三', 1))})""")
def tx_clause_bounds(f):
    return f.select("id", F.inline(clauses.bounds(F.col("text"))))


PARTS = "pre || chr(10) || chr(10) || head1 || chr(10) || '标的为设备 ' || CAST(id AS VARCHAR) || '。' || chr(10) || chr(10) || head2 || chr(10) || terms || chr(10) || chr(10) || head3 || chr(10) || dispute_text"


@texts(f"SELECT id, CAST(id AS VARCHAR) || ':0000' AS chunk_id, 0 AS index, {PARTS} AS text, {MARKS.format('一')} AS clause_marker, CAST(length({PARTS}) AS INT) AS char_count FROM f")
def tx_chunk(f):
    return clauses.chunk_rows(f, "id")


CLAUSES = """SELECT id, 1 AS sort_order, '合同基本信息' AS name, pre AS content, 'other' AS clause_type FROM f UNION ALL SELECT id, 2, '合同标的', '标的为设备 ' || CAST(id AS VARCHAR) || '。', 'main' FROM f
UNION ALL SELECT id, 3, '付款方式', terms, 'payment' FROM f UNION ALL SELECT id, 4, '争议解决', dispute_text, 'dispute' FROM f"""


@texts(CLAUSES)
def tx_segment_clauses(f):
    return f.select("id", F.inline(clauses.clauses(F.col("text"))))


@texts(f", c AS ({CLAUSES}) SELECT id, sort_order, name, content, clause_type FROM c WHERE id % 3 <> 0 UNION ALL SELECT id, 1, '全文', title, 'other' FROM f WHERE id % 3 = 0")
def ld_resplit(f):
    """Clauses of an earlier run, joined in order and cut anew; those of a contract that gives one clause only stay."""
    old = f.select("id", F.inline(F.expr("CASE WHEN id % 3 = 0 THEN array(named_struct('sort_order', 1, 'name', '全文', 'content', title, 'clause_type', 'other')) ELSE array(named_struct('sort_order', 2, 'name', 'b', 'content', substring(text, 31), 'clause_type', 'other'), named_struct('sort_order', 1, 'name', 'a', 'content', left(text, 30), 'clause_type', 'other')) END")))
    joined = old.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "name", "content", "clause_type"))).alias("old"))
    new = joined.withColumn("new", clauses.clauses(F.array_join(F.transform("old", lambda c: c["content"]), "")))
    return new.select("id", F.inline(F.when(F.size("new") > 1, F.col("new")).otherwise(F.col("old"))))


def with_elements(f: DataFrame) -> DataFrame:
    own = {"contract_code": "contract_code", "partner_a": "party_a", "amount": "amount", "sign_date": "signed_text", "payment_terms": "terms", "dispute_resolution": "dispute", "currency": "''"}
    cut = f.select("id", "text", clauses.clauses(F.col("text")).alias("clauses"), *[F.expr(e).alias(f"r_{n}") for n, e in own.items()])
    return cut.select("id", "clauses", F.inline(elements.elements({n: F.col(f"r_{n}") for n in own}, F.col("text"), F.col("clauses"), F.lit(0.8))))


#: Each element's value and, where it is in the text as it stands, its clause.
VALUES = [("contract_code", "contract_code", "1"), ("partner_a", "party_a", "1"), ("amount", "CAST(amount AS VARCHAR)", "CASE WHEN id % 3 = 0 THEN 1 END"), ("sign_date", "signed_text", "1"), ("payment_terms", "terms", "3"), ("dispute_resolution", "dispute", "CASE WHEN id % 5 = 1 OR id % 5 = 2 THEN 4 END")]
ELEMENTS = "e AS (" + " UNION ALL ".join(f"SELECT id, text, '{k}' AS element_key, {v} AS value_text, {c} AS clause_index FROM f" for k, v, c in VALUES) + "), g AS (SELECT *, length(value_text) <= 60 AS short, strpos(text, value_text) AS found, strpos(text, left(value_text, 12)) AS found12 FROM e WHERE value_text IS NOT NULL), h AS (SELECT *, CASE WHEN found > 0 THEN found WHEN length(value_text) > 12 AND found12 > 0 THEN found12 END AS p FROM g)"


@texts(f""", {ELEMENTS} SELECT id, element_key, value_text, CASE WHEN element_key = 'amount' THEN CAST(value_text AS DOUBLE) END AS value_number, CASE WHEN element_key = 'sign_date' THEN value_text END AS value_date,
CASE WHEN short THEN replace(substr(text, CAST(greatest(p - 40, 1) AS BIGINT), CAST(p + length(value_text) + 40 - greatest(p - 40, 1) AS BIGINT)), chr(10), ' ') END AS source_text, CASE WHEN short THEN clause_index END AS clause_index FROM h""")
def tx_build_elements(f):
    return with_elements(f).select("id", "element_key", "value_text", "value_number", "value_date", "source_text", "clause_index")


@texts(f", {ELEMENTS}, c AS ({CLAUSES}) SELECT h.id, element_key, c.name AS clause FROM h LEFT JOIN c ON c.id = h.id AND short AND c.sort_order = h.clause_index")
def jn_clause_elem(f):
    e = with_elements(f).select("id", "element_key", F.col("clause_index").alias("sort_order"))
    c = f.select("id", F.inline(clauses.clauses(F.col("text")))).select("id", "sort_order", F.col("name").alias("clause"))
    return e.join(c, ["id", "sort_order"], "left").select("id", "element_key", "clause")


@texts("SELECT id, CASE WHEN id % 2 = 0 THEN contract_code ELSE code END AS code, CASE WHEN id % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(amount AS DOUBLE) END AS amount, type FROM f")
def snk_ledger_apply(f):
    now = f.select("id", "code", F.col("amount").cast("double").alias("amount"), "type")
    found = f.select("id", F.expr("CASE WHEN id % 2 = 0 THEN contract_code ELSE '' END").alias("code"), F.expr("CASE WHEN id % 3 = 0 THEN 1D END").alias("amount"))
    return elements.overwritten(now, found, "id")


@texts("SELECT id, id % 4 <> 0 AS is_ai FROM f")
def ld_is_ai(f):
    return f.select("id", F.when(F.col("id") % 4 != 0, F.to_json(F.struct("contract_code"))).isNotNull().alias("is_ai"))


@texts("SELECT id, CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'done' END AS ai_status, CASE WHEN id % 4 = 0 THEN 'TEXT_TOO_SHORT' END AS ai_error FROM f")
def ld_mark_failed(f):
    text = F.when(F.col("id") % 4 == 0, "  短  ").otherwise(F.col("text"))
    error = F.when(F.length(F.trim(text)) < elements.LEAST_TEXT, "TEXT_TOO_SHORT")
    said = f.select("id", error.alias("ai_error"))
    return said.select("id", F.when(F.col("ai_error").isNotNull(), "failed").otherwise("done").alias("ai_status"), "ai_error")


@texts("SELECT id, contract_code, CASE WHEN id % 2 = 0 THEN 9 ELSE 1 END AS attempt_count, true AS used_few_shot FROM f")
def prj_flatten(f):
    own = F.struct("contract_code", F.when(F.col("id") % 2 == 0, 9).alias("attempt_count"))
    meta = {"attempt_count": F.lit(1), "used_few_shot": F.lit(True)}
    flat = f.select("id", own.alias("r")).select("id", "r.*")
    return flat.select("id", "contract_code", *[(F.coalesce(n, v) if n in flat.columns else v).alias(n) for n, v in meta.items()])


@texts(f"""SELECT CAST(id AS VARCHAR) || '.' || field AS id, question, ground_truth, answer FROM (
{' UNION ALL '.join(f"SELECT id, '{n}' AS field, '{q}' AS question, {g} AS ground_truth, {a} AS answer FROM f" for (n, q), g, a in zip(QUESTIONS.items(), ("contract_code", "party_a", "CAST(amount AS VARCHAR)", "coalesce(dispute, '')"), ("contract_code", "CASE WHEN id % 2 = 0 THEN party_a ELSE '' END", "''", "coalesce(dispute, '')")))}) WHERE ground_truth <> '' OR answer <> ''""")
def evl_pairs(f):
    gold = f.select("id", "contract_code", F.col("party_a").alias("partner_a"), "amount", F.col("dispute").alias("dispute_resolution"))
    said = f.select("id", fields.code(F.col("text")).alias("contract_code"), F.when(F.col("id") % 2 == 0, fields.party(F.col("text"), "甲方")).alias("partner_a"), F.lit(None).cast("double").alias("amount"), fields.dispute(F.col("text")).alias("dispute_resolution"))
    return elements.question_pairs(gold, said, "id", QUESTIONS)


@texts("SELECT id, attempts, CASE WHEN id % 5 = 4 THEN NULL ELSE contract_code END AS contract_code, id % 5 = 4 AS needs_review FROM (SELECT *, CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS attempts FROM f) WHERE id % 5 <> 3 UNION ALL SELECT id, 3, contract_code, false FROM f WHERE id % 5 = 3")
def ex_graph(f):
    """Extraction with checks: the first answers lack the code id % 5 times; each attempt reads the text anew, at most
    three in all, and what is still without a code goes to review."""
    bad = F.when(F.col("id") % 5 == 4, 9).otherwise(F.least(F.col("id") % 5, F.lit(2)))
    good = lambda n: F.struct(F.when(n > bad, fields.code(F.col("text"))).alias("value"), (n > bad).alias("ok"))
    tried = f.select("id", elements.attempts(good(F.lit(1)), lambda _, n: good(n)).alias("a"))
    last = F.element_at("a", -1)
    return tried.select("id", F.size("a").alias("attempts"), last["value"].alias("contract_code"), (~last["ok"]).alias("needs_review"))


@texts(f"SELECT id, CASE type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in KINDS.items())} END AS type, contract_code, CAST(amount AS DOUBLE) AS amount FROM f WHERE type <> 'other'")
def ex_chain(f):
    """Classification, then extraction, without a loop."""
    kind = classify.rule(F.col("title"), F.lit(""))["type"]
    return f.where("type <> 'other'").select("id", kind.alias("type"), fields.code(F.col("text")).alias("contract_code"), fields.amount(F.col("text")).alias("amount"))


@texts("""SELECT id, CASE WHEN id % 11 = 0 THEN 'TEXT_TOO_SHORT' END AS error_code, CASE WHEN id % 11 <> 0 THEN contract_code END AS contract_code, CASE WHEN id % 11 <> 0 THEN CAST(amount AS DOUBLE) END AS amount,
CASE WHEN id % 11 <> 0 THEN 3 ELSE 0 END AS payments, CASE WHEN id % 11 <> 0 THEN round((p1 + p2 + p3) / 100, 4) ELSE 0 END AS share, CASE WHEN id % 11 <> 0 THEN 4 ELSE 0 END AS clauses,
CASE WHEN id % 11 = 0 THEN 0 WHEN id % 5 = 4 THEN 4 ELSE 5 END AS elements, id % 11 = 0 OR id % 4 = 3 AS needs_review FROM f""")
def ex_pipeline(f):
    """From the text of an upload to fields, schedule, checks, clauses and elements. Texts under ten characters give an
    error and nothing else; payments that don't add up to all go to review."""
    t = F.when(F.col("id") % 11 == 0, " 短 ").otherwise(F.col("text"))
    d = f.select("id", F.when(F.length(F.trim(t)) < elements.LEAST_TEXT, "TEXT_TOO_SHORT").alias("error_code"), t.alias("t"))
    d = d.withColumn("t", F.when(F.col("error_code").isNull(), F.col("t")))
    own = {n: fields.FILLERS[n](F.col("t")) for n in ("contract_code", "partner_a", "amount", "sign_date", "dispute_resolution")}
    d = d.select("*", *[c.alias(n) for n, c in own.items()], clauses.clauses(F.col("t")).alias("cut"))
    terms = F.get(F.filter("cut", lambda c: c["clause_type"] == "payment"), F.lit(0))["content"]
    d = d.withColumn("plan", elements.milestones(terms)).withColumn("share", F.round(F.aggregate("plan", F.lit(0.0), lambda a, x: a + x["percent"]), 4))
    made_ = elements.elements({n: F.col(n) for n in own}, F.col("t"), F.col("cut"), F.lit(0.8))
    review = F.col("error_code").isNotNull() | (F.abs(F.col("share") - 1) > 0.02)
    return d.select("id", "error_code", "contract_code", "amount", F.size("plan").alias("payments"), F.coalesce("share", F.lit(0.0)).alias("share"), F.size("cut").alias("clauses"), F.size(made_).alias("elements"), review.alias("needs_review"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 40) END AS title FROM documents")
def tx_title_guess(spark, sf):
    # F.trim itself would be given the line's number as the characters to trim
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(text.SPACES))), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", F.left(F.get(lines, F.lit(0)), F.lit(40)).alias("title"))

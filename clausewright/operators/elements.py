"""What becomes of a contract's extracted fields: elements, the ledger's columns, schedules, attempts and question pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import checks
from clausewright.operators.clauses import bound

# The elements' keys, labels, groups and types, and the payment milestones with their labels, in order.
ELEMENTS = [
    ("contract_name", "合同名称", "basic", "text"),
    ("contract_code", "合同编号", "basic", "text"),
    ("contract_type", "合同类型", "basic", "selection"),
    ("partner_a", "甲方", "party", "text"),
    ("partner_b", "乙方", "party", "text"),
    ("amount", "合同金额", "amount", "number"),
    ("amount_uppercase", "金额大写", "amount", "text"),
    ("currency", "币种", "amount", "text"),
    ("sign_date", "签订日期", "date", "date"),
    ("effective_date", "生效日期", "date", "date"),
    ("expire_date", "失效日期", "date", "date"),
    ("payment_terms", "付款方式", "payment", "text"),
    ("breach_clause", "违约责任", "liability", "text"),
    ("dispute_resolution", "争议解决方式", "dispute", "text"),
]
MILESTONES = [
    ("预付", "prepayment", "预付款"),
    ("[到送]货?.*(验|收|交)", "on_delivery", "到货款"),
    ("[到送]货", "on_delivery", "到货款"),
    ("(完工|竣工|完成).*(验|收|交)", "on_completion", "验收款"),
    ("(验收|交(付|付?款)).*(合格|通过|完成)", "on_completion", "验收款"),
    ("尾款|余款|质保金|质保期届满", "final", "尾款"),
    ("分期|每月|按月|季度|按季", "installment", "分期款"),
]
SEARCHED, AROUND, SHORT = 60, 40, 12
LEAST_TEXT, ATTEMPTS = 10, 3


def source_of(value: Column, text: Column) -> Column:
    """The value's surroundings in a text, 40 characters each way; a long value may be found by its first 12."""
    at = F.when(F.instr(text, value) > 0, F.instr(text, value)).when(F.length(value) > SHORT, F.nullif(F.instr(text, F.left(value, F.lit(SHORT))), F.lit(0)))
    first = F.greatest(at - AROUND, F.lit(1))
    return F.replace(F.substring(text, first, at + F.length(value) + AROUND - first), F.lit("\n"), F.lit(" "))


def elements(record: dict[str, Column], text: Column, clauses: Column, confidence: Column) -> Column:
    """Array of an element for each field of the record that is neither null nor empty. Values of up to 60 characters
    have their surroundings and the number of the first clause whose content holds them."""
    kinds = {k: (label, group, kind) for k, label, group, kind in ELEMENTS}

    def one(key: str) -> Column:
        label, group, kind = kinds[key]
        said = record[key].cast("string")
        sought = F.when(F.length(said) <= SEARCHED, said)
        number = said.try_cast("double") if kind == "number" else F.lit(None).cast("double")
        return F.when(said != "", F.struct(
            F.lit(key).alias("element_key"), F.lit(label).alias("name"), F.lit(group).alias("group"),
            (F.when(number.isNull(), "text").otherwise(kind) if kind == "number" else F.lit(kind)).alias("element_type"),
            said.alias("value_text"), number.alias("value_number"), (said if kind == "date" else F.lit(None).cast("string")).alias("value_date"),
            source_of(sought, text).alias("source_text"), F.get(F.filter(clauses, lambda c: F.contains(c["content"], sought)), F.lit(0))["sort_order"].alias("clause_index"),
            confidence.alias("confidence"),
        ))

    return F.array_compact(F.array(*[one(k) for k, *_ in ELEMENTS if k in record]))


def milestones(terms: Column) -> Column:
    """Array of (name, milestone, percent, offset_days) of the sentences of payment terms that name a percentage."""
    cut = F.filter(F.transform(F.split(F.coalesce(terms, F.lit("")), "[；;\n]"), lambda s: F.trim(s)), lambda s: s.rlike(r"\d+(\.\d+)?\s*%|百分之\s*\d"))

    def one(s: Column, i: Column) -> Column:
        percent = F.coalesce(F.nullif(F.regexp_extract(s, r"(\d+(?:\.\d+)?)\s*%", 1), F.lit("")), F.regexp_extract(s, r"百分之\s*(\d+(?:\.\d+)?)", 1)).cast("double")
        code = F.coalesce(*[F.when(s.rlike(p), k) for p, k, _ in MILESTONES], F.lit("other"))
        label = F.coalesce(*[F.when(s.rlike(p), x) for p, _, x in MILESTONES], F.lit("其他"))
        return F.struct(F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(" 期 · "), label).alias("name"), code.alias("milestone"), (percent / 100).alias("percent"), checks.time_offset(s).alias("offset_days"))

    return F.transform(cut, one)


def overwritten(now: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """now with the values of found that are neither null nor empty, by key; its own stay elsewhere."""
    names = [c for c in found.columns if c != key]
    j = now.join(found.withColumnsRenamed({c: f"_new_{c}" for c in names}), key, "left")
    new = {c: F.when(F.col(f"_new_{c}").cast("string") != "", F.col(f"_new_{c}")) for c in names}
    return j.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in now.columns])


def attempts(first: Column, retry: Column, most: int = ATTEMPTS) -> Column:
    """Array of (attempt, value, ok) up to the first good one: retry(value, attempt) is the next value and whether it is
    good; the first is an attempt too, and there are at most `most`."""
    shape = F.transform(F.array(first), lambda x: F.struct(F.lit(1).alias("attempt"), x["value"].alias("value"), x["ok"].alias("ok")))

    def step(a: Column, i: Column) -> Column:
        last = F.element_at(a, -1)
        again = bound(retry(last["value"], i), lambda x: F.struct(i.alias("attempt"), x["value"].alias("value"), x["ok"].alias("ok")))
        return F.when(last["ok"], a).otherwise(F.array_append(a, again))

    return F.aggregate(F.sequence(F.lit(2), F.lit(most)), shape, step)


def question_pairs(gold: DataFrame, said: DataFrame, key: str, questions: dict[str, str]) -> DataFrame:
    """A row for each key and field with a gold or a given value: id, question, ground_truth, answer."""
    g = gold.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("ground_truth")) for f in questions])))
    p = said.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("answer")) for f in questions])))
    ask = F.create_map(*[F.lit(x) for kv in questions.items() for x in kv])
    pairs = g.join(p, [key, "field"]).where("ground_truth IS NOT NULL OR answer IS NOT NULL")
    return pairs.select(F.concat_ws(".", key, "field").alias("id"), ask[F.col("field")].alias("question"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"), F.coalesce("answer", F.lit("")).alias("answer"))

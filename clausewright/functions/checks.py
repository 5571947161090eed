"""Grades, fused decisions, checks of records and matches of answers, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright.functions.money import DIGITS, cn_whole


def page_class(chars: Column, images: Column) -> Column:
    return F.when(images >= 0.6, F.when(chars >= 50, "text_layered").otherwise("scanned")).otherwise("text")


def page_suspect(chars: Column, readable: Column, layered: Column) -> Column:
    return (chars < 30) | (readable < 0.5) | (layered & ((chars < 100) | (readable < 0.6)))


def doc_class(kind: Column) -> Column:
    """Aggregate of page classes: text without a scanned page, scanned without a text page, else mixed."""
    return F.when(~F.bool_or(kind == "scanned"), "text").when(F.bool_and(kind == "scanned"), "scanned").otherwise("mixed")


def conf_tier(conf: Column) -> Column:
    return F.when(conf <= 0.5, "dropped").when(conf < 0.85, "low").otherwise("ok")


def cn_int(t: Column) -> Column:
    """A whole number in Chinese numerals: digits side by side, or with units; null for other characters."""
    digits = "".join(DIGITS)
    figures = "".join(str(v) for v in DIGITS.values())
    plain = F.when(t.rlike(f"^[{digits}]+$"), F.translate(t, digits, figures).try_cast("int"))
    return F.coalesce(plain, F.when(t.rlike(f"^[{digits}十拾百佰千仟]+$"), cn_whole(t).cast("int")))


def cn_ratio(t: Column) -> Column:
    """The share that "百分之…" names, in per cent."""
    return cn_int(F.regexp_extract(t, "百分之([一二三四五六七八九十两]{1,3})", 1))




def time_offset(t: Column, default: int = 15) -> Column:
    """Days that a payment term names: days, months of 30 days, 0 on signing."""
    days, months = F.regexp_extract(t, "([0-9]+) *个?(?:工作日|日内|天内|日)", 1), F.regexp_extract(t, "([0-9]+) *个月", 1)
    return F.when(days != "", days.try_cast("int")).when(months != "", months.try_cast("int") * 30).when(t.contains("签订后"), 0).otherwise(default)


def json_part(t: Column) -> Column:
    """The object in an answer: of its fenced block, else from its first to its last brace; null if neither parses."""
    fenced, outer = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    valid = lambda s: F.when(F.try_parse_json(s).isNotNull() & s.rlike(r"^\s*\{"), F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.coalesce(valid(fenced), valid(t), valid(outer))


def fuse(rule: Column, rule_conf: Column, model: Column, model_conf: Column, failed: Column) -> Column:
    """(type, conf, method) of a rule's and a model's opinion."""
    agree = rule == model
    made = lambda kind, conf, how: F.struct(kind.alias("type"), F.round(conf, 4).alias("conf"), F.lit(how).alias("method"))
    sure = F.when(agree, F.least(model_conf + 0.05, F.greatest(F.lit(0.98), model_conf))).otherwise(model_conf)
    both = F.least(0.55 * rule_conf + 0.45 * model_conf + 0.1, F.lit(0.9))
    higher = F.when(model_conf >= rule_conf, model).otherwise(rule)
    return F.when(failed, made(rule, rule_conf, "rule_fallback")).when(model_conf >= 0.7, made(model, sure, "llm")).when(agree, made(model, both, "ensemble")).otherwise(made(higher, F.greatest(rule_conf, model_conf) * 0.85, "conflict"))


def needs_review(agree: Column, conf: Column) -> Column:
    return F.when(agree, conf < 0.5).otherwise(conf < 0.75)


def missing(*names: str) -> Column:
    """The names of the columns that are null or blank."""
    return F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) == "", n) for n in names]), lambda x: x.isNotNull())


def confidence(complete: Column, evidence: Column, errors: Column, fatal: Column, warnings: Column) -> Column:
    raw = 0.35 * complete + 0.35 * evidence + F.when(errors == 0, 0.3).otherwise(0.0) - 0.15 * errors - 0.1 * fatal - 0.05 * warnings
    return F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), raw)), 3)


def reasons(*rules: tuple[Column, str]) -> Column:
    """The texts of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, s) for c, s in rules]))


def amounts_match(gold: Column, said: Column, tolerance: float = 0.02) -> Column:
    return F.when(gold.isNull() & said.isNull(), True).when(gold.isNull() | said.isNull(), False).when(gold == 0, said == 0).otherwise(F.abs(said - gold) / F.abs(gold) < tolerance)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def share(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), 4)


def corrected(t: Column, glossary: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), glossary.items(), t)


def payment_nodes(t: Column) -> Column:
    """The payments a text agrees on: (label, ratio, amount, days) of each clause with a share or a sum; deposits aside."""

    def node(s: Column) -> Column:
        figures = F.regexp_extract(s, r"([0-9]+(?:\.[0-9]+)?) *[%％]", 1).try_cast("double")
        ratio = F.coalesce(figures, cn_ratio(s).cast("double")) / 100
        sum_ = F.regexp_extract(s, "([0-9][0-9,]*(?:\\.[0-9]+)?) *万?元", 1)
        amount = F.regexp_replace(sum_, ",", "").try_cast("double") * F.when(s.rlike("[0-9] *万元"), 10000.0).otherwise(1.0)
        days = F.regexp_extract(s, "([0-9]+) *个?(?:工作)?日内", 1).try_cast("int")
        label = F.when(s.rlike("预付|定金|订金|首付|签订|生效"), "prepayment").when(s.rlike("验收"), "on_completion").when(s.rlike("交付|到货|发货"), "on_delivery").when(s.rlike("质保|剩余|尾款"), "final").otherwise("milestone")
        return F.struct(label.alias("label"), ratio.alias("ratio"), amount.alias("amount"), days.alias("days"))

    parts = F.filter(F.split(F.coalesce(t, F.lit("")), "[；;。\n]"), lambda s: ~(s.contains("押金") & ~s.rlike("预付|定金|订金")))
    return F.filter(F.transform(parts, node), lambda n: n["ratio"].isNotNull() | n["amount"].isNotNull())


def rent_parts(t: Column) -> Column:
    """The equal payments of a rent: (number, amount), from the yearly or monthly rent and the period of payment."""
    sum_of = lambda kind: F.regexp_replace(F.regexp_extract(t, f"{kind}租金 *([0-9][0-9,]*(?:\\.[0-9]+)?) *元", 1), ",", "").try_cast("double")
    month, year = sum_of("月"), sum_of("年")
    n = F.when(t.contains("按半年"), 2).when(t.contains("按季"), 4).when(t.contains("按月"), 12).otherwise(1)
    whole = F.coalesce(year, month * 12)
    return F.when(whole.isNotNull(), F.struct(n.alias("n"), F.round(whole / n, 2).alias("amount")))

"""Filling fields from a contract's text, evidence for them, and the report of a record's checks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright.functions.money import cn_amount, date_norm

# Labels, suffixes and anchors of the fields in a text.
NUMBER = r"([0-9,]+(?:\.[0-9]+)?)"
TOTAL = r"(?:合同总金额|合同总价款|合同总价|总金额|总价款|总价)[为是：:\s]*(?:人民币)?\s*"
AMOUNTS = [(TOTAL + NUMBER + r"\s*万元", 10_000.0), (TOTAL + NUMBER + r"\s*元", 1.0), (r"人民币\s*" + NUMBER + r"\s*万元", 10_000.0), (r"人民币\s*" + NUMBER + r"\s*元", 1.0), (NUMBER + r"\s*万元", 10_000.0)]
CODES = [r"合同编号[：:]?\s*([A-Za-z0-9\-—－/]{4,32})", r"(?U)\b([A-Z]{2,8}[-—－][0-9]{4,8}(?:[-—－][0-9]{1,8})?)\b"]
SUFFIXES = "股份有限公司|有限公司|有限责任公司|集团|公司|厂|研究院|研究所|中心|大学|学院|事务所|银行"
DISPUTES = [("仲裁", "提交仲裁委员会仲裁"), ("人民法院|提起诉讼|向法院|法院起诉", "向人民法院提起诉讼"), ("调解", "调解解决"), ("协商", "协商解决")]
ANCHORS = {
    "sign_date": ["签订日期", "签订时间", "签字日期", "签约日期", "订立日期", "日期："],
    "effective_date": ["生效日期", "生效", "起生效", "自本合同", "履行期限自", "租期自"],
    "expire_date": ["失效日期", "到期日期", "有效期至", "截止日期", "履行期限至", "租期至", "至"],
}
CURRENCIES = {"CNY": "人民币|RMB|CNY", "USD": "美元|USD", "EUR": "欧元|EUR", "HKD": "港币|HKD", "JPY": "日元|JPY"}
SYMBOLS = {"CNY": ["元", "人民币", "¥", "RMB"], "USD": ["美元", "$", "USD"], "EUR": ["欧元", "€", "EUR"], "GBP": ["英镑", "£", "GBP"], "HKD": ["港币", "HK$", "HKD"], "JPY": ["日元", "JPY"]}
CRITICAL = ["partner_a", "partner_b", "amount", "sign_date", "contract_code"]
WINDOW = 80


def first_group(t: Column, *patterns: str) -> Column:
    """The first group of the first pattern that is found; null if none is."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])


def code(t: Column) -> Column:
    return first_group(t, *CODES)


def number(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("")).try_cast("double")


def amount(t: Column) -> Column:
    return F.coalesce(*[F.round(number(first_group(t, p)) * times, 2) for p, times in AMOUNTS])


def capital_amount(t: Column) -> Column:
    """The first run of capital numerals before 元, which may be the bare 万 of an amount in figures."""
    return F.regexp_replace(first_group(t, r"([零壹贰叁肆伍陆柒捌玖拾佰仟万亿]+\s*元\s*整?)"), r"\s", "")


def date_near(t: Column, field: str) -> Column:
    """The date within 80 characters from the first place of an anchor, anchors in order; a signing date also without one."""
    near = lambda a: F.when(F.instr(t, a) > 0, date_norm(F.substring(t, F.instr(t, a), F.lit(WINDOW))))
    return F.coalesce(*map(near, ANCHORS[field]), *([date_norm(t)] if field == "sign_date" else []))


def party(t: Column, side: str) -> Column:
    """The organisation named after 甲方 or 乙方 and an optional role in brackets."""
    role = r"(?:\([^)]{1,14}\)|（[^）]{1,14}）)?[：:]?\s*"
    return first_group(t, f"{side}{role}([一-龥A-Za-z0-9][一-龥A-Za-z0-9 ]{{1,38}}?(?:{SUFFIXES}))")


def one_of(t: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(t.rlike(p), v) for p, v in rules])


def dispute(t: Column) -> Column:
    return one_of(t, DISPUTES)


def currency_of(t: Column) -> Column:
    return one_of(t, [(p, k) for k, p in CURRENCIES.items()])


#: How each field is found in a text.
FILLERS = {
    "contract_code": code,
    "amount": amount,
    "amount_uppercase": capital_amount,
    "sign_date": lambda t: date_near(t, "sign_date").cast("string"),
    "effective_date": lambda t: date_near(t, "effective_date").cast("string"),
    "expire_date": lambda t: date_near(t, "expire_date").cast("string"),
    "partner_a": lambda t: party(t, "甲方"),
    "partner_b": lambda t: party(t, "乙方"),
    "dispute_resolution": dispute,
    "currency": currency_of,
}


def filled(t: Column, name: str) -> Column:
    """The field as given; where it is null or blank, as found in the text."""
    given = F.col(name)
    if name != "amount":
        given = F.when(F.trim(given) != "", given)
    return F.coalesce(given, FILLERS[name](t))


def amounts_in(t: Column) -> Column:
    """All numbers of a text, those before 万 times 10,000."""
    found = F.regexp_extract_all(t, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?\s*万?"), 0)
    return F.transform(found, lambda s: number(F.regexp_replace(s, r"[\s万]", "")) * F.when(F.contains(s, F.lit("万")), 10_000.0).otherwise(1.0))


def dates_in(t: Column) -> Column:
    """All valid dates of a text, as yyyy-MM-dd."""
    arabic = F.regexp_extract_all(t, F.lit(r"[0-9]{4}\s*[年/.-]\s*[0-9]{1,2}\s*[月/.-]\s*[0-9]{1,2}"), 0)
    chinese = F.regexp_extract_all(t, F.lit("[〇零一二三四五六七八九]{4}年[一二三四五六七八九十]{1,3}月[一二三四五六七八九十]{1,3}日"), 0)
    return F.array_compact(F.array_distinct(F.transform(F.concat(arabic, chinese), lambda s: date_norm(s).cast("string"))))


def squeezed(t: Column) -> Column:
    """In lower case, without white space; full-width forms are for `nfkc` to fold before."""
    return F.lower(F.regexp_replace(t, r"(?U)\s", ""))


def has_amount(t: Column, value: Column) -> Column:
    return F.exists(amounts_in(t), lambda a: F.abs(a - value) < 0.01)


def has_currency(t: Column, kind: Column) -> Column:
    return F.coalesce(*[F.when(F.upper(kind) == k, F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))) for k, words in SYMBOLS.items()], F.lit(False))


def evidence(t: Column) -> Column:
    """For each field that isn't null, whether the text holds it: a map."""
    plain = squeezed(t)
    rules = {
        "amount": has_amount(t, F.col("amount")),
        "amount_uppercase": F.contains(F.regexp_replace(t, r"\s", ""), F.regexp_extract("amount_uppercase", "([零壹贰叁肆伍陆柒捌玖拾佰仟万亿]+)", 1)),
        "currency": has_currency(t, F.col("currency")),
        **{n: F.array_contains(dates_in(t), F.col(n)) for n in ("sign_date", "effective_date", "expire_date")},
        **{n: F.contains(plain, squeezed(F.col(n))) for n in ("contract_code", "partner_a", "partner_b")},
    }
    pairs = F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("key"), F.coalesce(c, F.lit(False)).alias("value"))) for n, c in rules.items()])
    return F.map_from_entries(F.array_compact(pairs))


def valid_date(name: str) -> Column:
    c = F.col(name)
    return F.coalesce(F.year(F.try_to_date(F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c), "yyyy-MM-dd")).between(1990, 2100), F.lit(False))


def critical_missing() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == ""), n) for n in CRITICAL]))


def report(found: Column, fallback: Column) -> Column:
    """(errors, fatal, warnings, confidence) of a record whose evidence is `found`.

    Errors: dates without form or beyond 1990 to 2100, an amount not above 0 or over 1e10, capitals that say another
    amount, a dispute resolution outside the four, a field without evidence. Fatal: a critical field is missing."""
    dates = ["sign_date", "effective_date", "expire_date"]
    said = cn_amount(F.col("amount_uppercase"))
    no_evidence = F.transform(F.map_keys(F.map_filter(found, lambda k, v: ~v)), lambda k: F.concat(F.lit("evidence:"), k))
    errors = F.array(
        *[F.when(F.col(n).isNotNull() & ~valid_date(n), f"date:{n}") for n in dates],
        F.when((F.col("amount") <= 0) | (F.col("amount") > 1e10), "amount"),
        F.when(F.abs(said - F.col("amount")) >= 0.01, "amount_cross"),
        F.when(~F.col("dispute_resolution").isin([v for _, v in DISPUTES]), "enum"),
    )
    errors = F.concat(F.array_compact(errors), no_evidence)
    warnings = F.array_compact(F.array(F.when(F.col("sign_date") > F.col("effective_date"), "sign_after_effective"), F.when(F.col("effective_date") > F.col("expire_date"), "effective_after_expire")))
    fatal = critical_missing()
    names = ["contract_code", "partner_a", "partner_b", "amount", "sign_date"]
    complete = sum((F.when(F.col(n).isNotNull(), 1.0).otherwise(0.0) for n in names), F.lit(0.0)) / len(names)
    rate = F.when(F.size(found) > 0, F.size(F.filter(F.map_values(found), lambda v: v)) / F.size(found)).otherwise(0.0)
    raw = 0.35 * complete + 0.35 * rate + F.when(F.size(errors) == 0, 0.3).otherwise(0.0) - 0.15 * F.size(errors) - 0.1 * F.size(fatal) - 0.05 * F.size(warnings)
    raw = F.least(F.lit(0.99), F.greatest(F.lit(0.01), raw))
    conf = F.round(F.when(fallback, F.least(raw, F.lit(0.3))).otherwise(raw), 3)
    return F.struct(errors.alias("errors"), fatal.alias("fatal"), warnings.alias("warnings"), conf.alias("confidence"))


def date_eval(t: Column) -> Column:
    """A date of an evaluated answer: separators of any kind, or eight or six digits; null if none is valid."""
    t = F.trim(t)
    digits = F.when(t.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
    short = F.when(t.rlike("^[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}$"), date_norm(F.concat(F.lit("20"), t)))
    return F.coalesce(date_norm(t), F.try_to_date(digits, "yyyy-MM-dd"), short)


def date_ledger(t: Column) -> Column:
    """A date as the ledger takes it: separators made hyphens, then strictly yyyy-MM-dd."""
    t = F.regexp_replace(F.regexp_replace(F.trim(t), "[年月/.]", "-"), "日", "")
    return F.try_to_date(F.when(F.length(t) == 10, t), "yyyy-MM-dd")


def containment(part: Column, whole: Column) -> Column:
    """The share of the tokens of `part` that the text `whole` holds; 0 without tokens."""
    n = F.size(part)
    return F.when(n > 0, F.round(F.size(F.filter(part, lambda x: F.contains(whole, x))) / n, 4)).otherwise(0.0)


def fuzzy_match(a: Column, b: Column) -> Column:
    """Equal once normalised, one within the other, or the same numbers in the same order."""
    x, y = squeezed(a), squeezed(b)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)
    return (x == y) | F.contains(x, y) | F.contains(y, x) | ((F.size(numbers(a)) > 0) & (numbers(a) == numbers(b)))

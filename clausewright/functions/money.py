"""Amounts, dates and vectors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Capital and plain numerals, and their units.
DIGITS = {"零": 0, "〇": 0, "壹": 1, "一": 1, "贰": 2, "二": 2, "两": 2, "叁": 3, "三": 3, "肆": 4, "四": 4, "伍": 5, "五": 5, "陆": 6, "六": 6, "柒": 7, "七": 7, "捌": 8, "八": 8, "玖": 9, "九": 9}
UNITS = {"拾": 10, "十": 10, "佰": 100, "百": 100, "仟": 1000, "千": 1000}
SECTIONS = {"万": 10_000, "亿": 100_000_000}


def lookup(c: Column, values: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])[c]


def cn_whole(t: Column) -> Column:
    """The value of a run of numerals without parts of a yuan: a fold over (total, section, digit)."""
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("d"))

    def step(a: Column, c: Column) -> Column:
        digit, unit, section = lookup(c, DIGITS), lookup(c, UNITS), lookup(c, SECTIONS)
        one = F.when(a["d"] == 0, 1.0).otherwise(a["d"])
        t = F.when(section.isNotNull(), a["t"] + F.when(a["s"] + a["d"] == 0, 1.0).otherwise(a["s"] + a["d"]) * section).otherwise(a["t"])
        s = F.when(section.isNotNull(), 0.0).when(unit.isNotNull(), a["s"] + one * unit).otherwise(a["s"])
        d = F.when(digit.isNotNull(), digit).when(unit.isNotNull() | section.isNotNull(), 0.0).otherwise(a["d"])
        return F.struct(t.alias("t"), s.alias("s"), d.alias("d"))

    return F.aggregate(F.split(t, ""), start, step, lambda a: a["t"] + a["s"] + a["d"])


def cn_amount(t: Column) -> Column:
    """Yuan of an amount in capital numerals; null if it has none or isn't positive."""
    run = F.regexp_extract(t, "([零〇壹一贰二两叁三肆四伍五陆六柒七捌八玖九拾十佰百仟千万亿]+)[元圆]?", 1)
    part = lambda unit: F.coalesce(lookup(F.regexp_extract(t, f"([壹一贰二两叁三肆四伍五陆六柒七捌八玖九]){unit}", 1), DIGITS), F.lit(0.0))
    value = F.round(cn_whole(run) + part("角") / 10 + part("分") / 100, 2)
    return F.when((run != "") & (value > 0), value)


def date_norm(t: Column) -> Column:
    """The first valid date between 1990 and 2100: in figures, else in Chinese numerals."""
    p = r"([0-9]{4})\s*[年/.-]\s*([0-9]{1,2})\s*[月/.-]\s*([0-9]{1,2})"
    figures = F.concat_ws("-", F.regexp_extract(t, p, 1), F.lpad(F.regexp_extract(t, p, 2), 2, "0"), F.lpad(F.regexp_extract(t, p, 3), 2, "0"))
    q = "([〇零一二三四五六七八九]{4})年([一二三四五六七八九十]{1,3})月([一二三四五六七八九十]{1,3})日"
    year = F.translate(F.regexp_extract(t, q, 1), "〇零一二三四五六七八九", "00123456789")
    two = lambda i: F.lpad(cn_whole(F.regexp_extract(t, q, i)).cast("int").cast("string"), 2, "0")
    chinese = F.when(year != "", F.concat_ws("-", year, two(2), two(3)))
    valid = lambda s: F.try_to_date(F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s), "yyyy-MM-dd")
    within = lambda d: F.when(F.year(d).between(1990, 2100), d)
    return F.coalesce(within(valid(figures)), within(valid(chinese)))


def amount_loose(t: Column) -> Column:
    """A number with commas, a currency sign and a unit; 0 if there is none."""
    n = F.regexp_replace(F.regexp_extract(t, r"([0-9][0-9,]*\.?[0-9]*)", 1), ",", "").try_cast("double")
    unit = F.when(t.contains("亿"), 1e8).when(t.contains("万"), 1e4).otherwise(1.0)
    return F.coalesce(n * unit, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

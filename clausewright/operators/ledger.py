"""Joins, roll-ups, scans and checks over contracts and payment plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def is_overdue(as_of: str) -> Column:
    """Not paid or cancelled, due before as_of, and without an actual payment."""
    return ~F.col("state").isin("paid", "cancelled") & (F.col("planned_date") < F.lit(as_of).cast("date")) & F.col("actual").isNull()


def remaining() -> Column:
    return F.col("planned") - F.coalesce(F.col("actual"), F.lit(0))


def direction(kind: str = "type") -> Column:
    return F.when(F.col(kind).isin("purchase", "lease"), "payable").when(F.col(kind).isin("sale", "service", "labor", "partnership", "consulting"), "receivable")


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast(MONEY).alias(c)


def plan_summary(contracts: DataFrame, plans: DataFrame, as_of: str) -> DataFrame:
    """Each contract with its plans' count and sums: zero, not null, where it has none. Plans are summed before the
    join, so that only one row per contract meets its contract."""
    sums = plans.groupBy("contract_id").agg(
        F.count("*").alias("plan_count"), F.sum("planned").alias("planned_total"), F.sum(F.when(F.col("state") == "paid", F.col("actual"))).alias("paid_total"),
        F.count(F.when(is_overdue(as_of), 1)).alias("overdue_count"),
    )
    j = contracts.join(sums, contracts.id == sums.contract_id, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("plan_count", "overdue_count")]
    rest = (F.coalesce("planned_total", F.lit(0)) - F.coalesce("paid_total", F.lit(0))).cast(MONEY).alias("remaining_total")
    return j.select(*contracts.columns, *counts, zero("planned_total"), zero("paid_total"), rest)


def with_partners(contracts: DataFrame, customers: DataFrame) -> DataFrame:
    c = customers.select(F.col("c_custkey").alias("partner_a"), F.col("c_name").alias("partner_a_name"))
    return contracts.join(c, "partner_a", "left")


def export_order(df: DataFrame) -> DataFrame:
    """Newest first, those without a date before all, then by code."""
    return df.orderBy(F.desc_nulls_first("date_signed"), "code")


# The headings of the exported sheet, each with the column that it shows.
SHEET = {
    "合同编号": "code",
    "合同名称": "name",
    "类型": "type_label",
    "状态": "state_label",
    "甲方": "partner_a_name",
    "乙方": "partner_b_name",
    "签订日期": "date_signed",
    "生效日期": "date_start",
    "到期日期": "date_end",
    "合同金额": "amount",
    "币种": "currency",
    "计划总额": "planned_total",
    "已完成": "paid_total",
    "剩余": "remaining_total",
    "付款计划数": "plan_count",
    "逾期数": "overdue_count",
    "AI 来源": "is_ai",
}
#: Columns of the sheet that hold a number, which is 0 where there is none.
NUMBERS = ("amount", "planned_total", "paid_total", "remaining_total", "plan_count", "overdue_count")


def sheet(df: DataFrame) -> DataFrame:
    """The list sheet, in export_order(): a code that is missing is /, other texts empty, numbers 0; yes or no for is_ai.

    A column that df lacks is one without values."""

    def cell(c: str) -> Column:
        v = F.col(c) if c in df.columns else F.lit(None)
        if c == "is_ai":
            return F.when(v.cast("boolean"), "是").otherwise("否")
        if c in NUMBERS:
            return F.coalesce(v, F.lit(0))
        return F.coalesce(v.cast("string"), F.lit("/" if c == "code" else ""))

    return export_order(df).select(*[cell(c).alias(heading) for heading, c in SHEET.items()])


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Each sheet as CSV with its headings, in a folder of its name, replaced if there."""
    for name, df in sheets.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def type_summary(summary: DataFrame) -> DataFrame:
    """Count, amount, paid and paid share by type, with a total row."""
    t = summary.rollup("type").agg(F.count("*").alias("n"), F.sum("amount").cast(MONEY).alias("amount"), F.sum("paid_total").cast(MONEY).alias("paid"), F.grouping("type").alias("g"))
    share = F.when(F.col("amount") == 0, F.lit(0.0)).otherwise(F.col("paid").cast("double") / F.col("amount").cast("double") * 100)
    return t.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("type")).alias("type"), "n", "amount", "paid", F.format_string("%.1f%%", share).alias("paid_pct"))


def pivot(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums of the measures for all prefixes of keys; a subtotal's keys are ALL."""
    t = df.rollup(*keys).agg(*[F.sum(m).cast(MONEY).alias(m) for m in measures], *[F.grouping(k).alias(f"_{k}") for k in keys])
    return t.select(*[F.when(F.col(f"_{k}") == 1, "ALL").otherwise(F.coalesce(k, F.lit("NONE"))).alias(k) for k in keys], *measures)


def expand_groups(df: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Counts of all values of the domain, those without rows too."""
    every = df.sparkSession.createDataFrame([(i, d) for i, d in enumerate(domain)], f"ord int, {key} string")
    return every.join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").select("ord", key, F.coalesce("n", F.lit(0)).alias("n"))


def overdue_lines(plans: DataFrame, as_of: str) -> DataFrame:
    """Overdue plans of each contract as one text, in the order of their dates."""
    due = plans.where(F.col("state").isin("draft", "confirmed", "partial") & (F.col("planned_date") < F.lit(as_of).cast("date")) & F.col("actual").isNull())
    item = F.struct("planned_date", "planned", "line", "part")
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["planned_date"].cast("string"), F.lit(" "), x["planned"].cast("string")))
    return due.groupBy("contract_id").agg(F.count("*").alias("n"), F.array_join(lines, "; ").alias("lines"))


def numbered(df: DataFrame, parent: str, *order: str) -> DataFrame:
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def latest(df: DataFrame, key: str, *newest: str) -> DataFrame:
    """The row of each key that comes first in descending order: a maximum of structs, which needs no sort."""
    rest = [c for c in df.columns if c != key and c not in newest]
    return df.groupBy(key).agg(F.max(F.struct(*newest, *rest)).alias("r")).select(key, "r.*")


def party_counts(contracts: DataFrame, plans: DataFrame) -> DataFrame:
    """Contracts in which a party stands as A plus those in which it stands as B; both count."""
    a = contracts.select(F.col("partner_a").alias("party"))
    b = plans.select("contract_id", F.col("partner_b").alias("party")).distinct().select("party")
    return a.unionAll(b).groupBy("party").agg(F.count("*").alias("n"))


def expired(contracts: DataFrame, as_of: str) -> DataFrame:
    return contracts.withColumn("state", F.when((F.col("date_end") < F.lit(as_of).cast("date")) & (F.col("state") == "seal"), "archived").otherwise(F.col("state")))


def replace_by_source(now: DataFrame, new: DataFrame, source: str) -> DataFrame:
    return now.where(F.col("source") != source).unionByName(new)


def upsert(now: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return now.join(new.select(key), key, "left_anti").unionByName(new)


def schedule(contracts: DataFrame, nodes: list[tuple[str, float, int]]) -> DataFrame:
    """Planned amounts and dates of each contract with a positive amount; nodes are (name, share, days after signing)."""
    parts = F.array(*[F.struct(F.lit(i + 1).alias("seq"), F.lit(n).alias("name"), F.lit(str(p)).cast("decimal(5,4)").alias("p"), F.lit(d).alias("d")) for i, (n, p, d) in enumerate(nodes)])
    each = contracts.where(F.col("amount") > 0).withColumn("x", F.explode(parts))
    return each.select("id", F.col("x.seq").alias("seq"), F.col("x.name").alias("name"), F.round(F.col("amount") * F.col("x.p"), 2).cast(MONEY).alias("planned"), F.expr("date_add(date_signed, x.d)").alias("planned_date"))


def sum_check(total: Column, parts: Column) -> Column:
    """Whether parts add up to total within the larger of .01 and 1 %; null if either is missing."""
    return F.when(total.isNotNull() & parts.isNotNull(), F.abs(parts - total) <= F.greatest(F.lit(0.01).cast("double"), F.abs(total).cast("double") * 0.01))


def compile_filter(condition: dict) -> Column:
    """A metadata filter as a predicate: equality, $and, $or, $eq, $ne, $gt, $gte, $lt, $lte, $in, $nin."""
    ops = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
        "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v),
    }
    out = F.lit(True)
    for k, v in condition.items():
        if k in ("$and", "$or"):
            each = [compile_filter(x) for x in v]
            got = each[0]
            for x in each[1:]:
                got = got & x if k == "$and" else got | x
        elif isinstance(v, dict):
            got = F.lit(True)
            for op, x in v.items():
                got = got & ops[op](F.col(k), x)
        else:
            got = F.col(k) == v
        out = out & got
    return out


def saved_filters(df: DataFrame, groups: dict[str, dict[str, str]], chosen: list[str]) -> DataFrame:
    """The rows that pass the chosen filters: any of a group's, of every group that has one chosen."""
    for named in groups.values():
        picked = [f"({named[n]})" for n in chosen if n in named]
        if picked:
            df = df.where(" OR ".join(picked))
    return df


def named_payments(c: DataFrame, nodes: list[tuple[str | None, str | None, str | None]]) -> DataFrame:
    """id, seq, planned, planned_date of the payments (share, sum, days) that were named for each contract.

    The sum, else the share of the amount; nothing where that is 0. Without days, 30 for each payment before it,
    those left out counted."""
    share, money_ = "decimal(5,4)", "decimal(18,2)"
    rows = [F.struct(F.lit(i).alias("seq"), F.lit(r).cast(share).alias("ratio"), F.lit(s).cast(money_).alias("said"), F.lit(d).cast("int").alias("days")) for i, (r, s, d) in enumerate(nodes, 1)]
    n = c.select("id", "amount", "date_signed", F.inline(F.array(*rows)))
    planned = F.round(F.when(F.col("said") != 0, F.col("said")).otherwise(F.coalesce(F.col("amount") * F.col("ratio"), F.lit(0))), 2).cast(money_)
    return n.select("id", "seq", planned.alias("planned"), F.expr("date_add(date_signed, coalesce(days, 30 * (seq - 1)))").alias("planned_date")).where("planned > 0")

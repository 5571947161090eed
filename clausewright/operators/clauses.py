"""Headings, clauses and chunks of whole texts, as Column expressions over the array of a text's lines.

Headings stand at the start of a line, so lines are judged one by one and a text is cut by slices between their numbers.
Only what depends on the piece before, as a chunk's fill does, is a fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numerals, headings from the strongest kind down, clause types and sizes.
CN = "一二三四五六七八九十百千万〇零两"
HEADINGS = [
    rf"^\s*(第[{CN}\d]+[条章节部分篇])\s*[:：]?\s",
    r"^\s*(\d{1,3})[\.、)\)】]\s",
    rf"^\s*([{CN}]+)[、]\s*",
    rf"^\s*[（(]([{CN}\d]+)[）)]\s*",
    r"^\s*(争议解决|违约责任|付款方式|保密|不可抗力|合同生效|合同终止|特别约定|其他约定|定义|鉴于|甲方|乙方)\s*[:：]?\s*$",
]
CLAUSE_TYPES = [
    ("dispute", "争议|纠纷|仲裁|诉讼|管辖|法院"),
    ("confidential", "保密|商业秘密"),
    ("force_majeure", "不可抗力"),
    ("intellectual_property", "知识产权|著作权|专利|商标|版权"),
    ("warranty", "质保|保修|质量标准|验收标准|售后服务"),
    ("termination", "解除|终止|退出"),
    ("payment", "付款|支付|价款|费用|结算|发票|押金|租金|定金|预付|报酬"),
    ("main", "金额|期限|生效|标的|大写|违约|赔偿|责任|权利|义务|履行"),
]
FORMAL = r"^\s*第\s*[零一二两三四五六七八九十百千0-9０-９]+\s*[条款章][、.．:：\s]*"
NUMBERED = [r"^\s*\d{1,3}\s*[、.．]\s*(?!\d)", r"^\s*[一二三四五六七八九十]{1,3}\s*、\s*"]
BASICS, WHOLE = "合同基本信息", "全文"
MAX_CHARS, OVERLAP, MIN_CHARS = 800, 50, 200
LINE, TITLE, NAME, CLAUSES, HEAD = 60, 30, 50, 200, 5000
KEYED, ITEM, ENDED = "^[^：:]{1,20}[：:]", r"^[（(][一二三四五六七八九十\d]{1,3}[)）]|^\d{1,2}[、.．]", "[。！？；A-Za-z0-9%)]$"

UNICODE = "(?U)"
BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
PART = "array<struct<text:string,marker:string>>"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, UNICODE + r"^\s+|\s+$", "")


def lines_of(t: Column) -> Column:
    """The lines of a text at any kind of line break; a last empty one doesn't count."""
    cut = F.split(F.coalesce(t, F.lit("")), BREAKS)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: the only element of an array, transformed."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def marker_of(line: Column) -> Column:
    """The marker of the strongest kind of heading that begins a line, which ends with its break; null if none does."""
    found = [F.nullif(F.regexp_extract(line, UNICODE + p, 1), F.lit("")) for p in HEADINGS]
    return F.trim(F.coalesce(*found))


def sections(t: Column) -> Column:
    """Array of (first, last, marker, before, behind): line numbers from each heading to before the next, and of what
    stands before the first with marker null; what stands in the heading's line before its marker, as a bracket, and the
    same of the next heading. With the lines, as struct(lines, cuts)."""
    lines = F.split(F.coalesce(t, F.lit("")), "\n")

    def cuts(own: Column) -> Column:
        ended = F.transform(own, lambda x, i: F.when(i < F.size(own) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
        marks = F.transform(ended, lambda x, i: F.struct(i.alias("at"), marker_of(x).alias("marker")))
        heads = F.transform(F.filter(marks, lambda x: x["marker"].isNotNull()), lambda x: F.struct(x["at"], x["marker"], F.left(F.get(own, x["at"]), F.instr(F.get(own, x["at"]), x["marker"]) - 1).alias("before")))
        first = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("marker"), F.lit("").alias("before")))

        def cut(h: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                after = F.get(h, j + 1)
                return F.struct(x["at"].alias("first"), F.coalesce(after["at"], F.size(own)).alias("last"), x["marker"].alias("marker"), x["before"].alias("before"), F.coalesce(after["before"], F.lit("")).alias("behind"))

            return F.struct(own.alias("lines"), F.transform(h, one).alias("cuts"))

        return bound(F.concat(first, heads), cut)

    return bound(lines, cuts)


def text_between(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first), "\n")


def bounds(t: Column) -> Column:
    """Array of (start, end, marker) of the headings, in code points, by place."""

    def places(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,marker:string>>").alias("out"))

        def step(a: Column, c: Column) -> Column:
            own = text_between(s["lines"], c["first"], c["last"])
            at = a["pos"] + F.instr(own, c["marker"]) - 1
            hit = F.struct(at.alias("start"), (at + F.length(c["marker"])).alias("end"), c["marker"].alias("marker"))
            after = a["pos"] + F.length(own) + F.when(c["last"] > c["first"], 1).otherwise(0)
            return F.struct(after.alias("pos"), F.when(c["marker"].isNull(), a["out"]).otherwise(F.array_append(a["out"], hit)).alias("out"))

        return F.aggregate(s["cuts"], start, step, lambda a: a["out"])

    return bound(sections(t), places)


def parts(t: Column) -> Column:
    """Array of (text, marker): what stands before the first marker and from each to the next, none empty; of a text
    without headings, its paragraphs of ten characters or more."""

    def cut(s: Column) -> Column:
        whole = lambda c: text_between(s["lines"], c["first"], c["last"])
        own = F.transform(s["cuts"], lambda c: F.struct(strip(F.concat(F.substring(whole(c), F.length(c["before"]) + 1, F.length(whole(c))), F.lit("\n"), c["behind"])).alias("text"), c["marker"].alias("marker")))
        paras = F.transform(F.split(F.coalesce(t, F.lit("")), UNICODE + r"\n\s*\n"), lambda x: F.struct(strip(x).alias("text"), F.lit(None).cast("string").alias("marker")))
        return F.when(F.size(s["cuts"]) == 1, F.filter(paras, lambda p: F.length(p["text"]) >= 10)).otherwise(F.filter(own, lambda p: p["text"] != ""))

    return bound(sections(t), cut)


def windows(t: Column, most: int, overlap: int) -> Column:
    """Array of texts of at most `most` characters: cut behind the last sentence's end in the second half, if there is
    one; each begins `overlap` before the end of the one before."""
    size, half = F.length(t), most // 2
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        own = F.substring(t, a["at"] + 1, F.lit(most))
        ahead = F.length(F.regexp_extract(F.substring(own, F.lit(half + 2), F.lit(most)), r"(?s)^(.*[。.！?\n])", 1))
        cut = F.when((a["at"] + most < size) & (ahead > 0), half + 1 + ahead).otherwise(F.length(own))
        end = a["at"] + cut
        after = F.when(end >= size, size).otherwise(end - overlap)
        return F.when(a["at"] >= size, a).otherwise(F.struct(after.alias("at"), F.array_append(a["out"], strip(F.substring(own, F.lit(1), cut))).alias("out")))

    steps = F.sequence(F.lit(0), F.floor(size / max(1, half - overlap)).cast("int") + 1)
    return F.when(size <= most, F.array(t)).otherwise(F.filter(F.aggregate(steps, start, step, lambda a: a["out"]), lambda x: x != ""))


def tail(t: Column, overlap: int) -> Column:
    """What the next chunk repeats: of the last 2 x overlap characters those behind the last 。 or line break, if they
    are over four, else the last `overlap`."""
    if overlap <= 0:
        return F.lit("")
    end = F.right(t, F.lit(2 * overlap))
    behind = F.regexp_extract(end, r"(?s)^.*[。\n](.*)$", 1)
    return F.when(F.length(t) <= overlap, t).when(end.rlike(r"[。\n]") & (F.length(behind) > 4), behind).otherwise(F.right(t, F.lit(overlap)))


def chunks(t: Column, most: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS) -> Column:
    """Array of (index, text, marker): parts joined up to `most` characters. Chunks under `least` without a marker go; if
    none is left, the first part is the chunk. Null and empty texts have none."""

    def fill(raw: Column) -> Column:
        pieces = F.flatten(F.transform(raw, lambda p: F.transform(windows(p["text"], most, overlap), lambda x: F.struct(x.alias("text"), p["marker"].alias("marker")))))
        none = F.lit(None).cast("string")
        start = F.struct(F.array().cast(PART).alias("done"), F.lit("").alias("held"), none.alias("marker"))

        def step(a: Column, p: Column) -> Column:
            marker = F.coalesce(a["marker"], p["marker"])
            full = (a["held"] != "") & (F.length(a["held"]) + F.length(p["text"]) + 1 > most)
            done = F.when(full, F.array_append(a["done"], F.struct(a["held"].alias("text"), marker.alias("marker")))).otherwise(a["done"])
            before = F.when(full, tail(a["held"], overlap)).otherwise(a["held"])
            held = F.when(before == "", p["text"]).otherwise(F.concat(before, F.lit("\n\n"), p["text"]))
            return F.struct(done.alias("done"), held.alias("held"), F.when(full, none).otherwise(marker).alias("marker"))

        end = lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.array_append(a["done"], F.struct(a["held"].alias("text"), a["marker"].alias("marker"))))
        kept = F.filter(F.aggregate(pieces, start, step, end), lambda c: (F.length(c["text"]) >= least) | c["marker"].isNotNull())
        return bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.slice(raw, 1, 1)))

    return F.transform(bound(parts(t), fill), lambda c, i: F.struct(i.alias("index"), c["text"].alias("text"), c["marker"].alias("marker")))


def type_of(name: Column, content: Column) -> Column:
    """The first clause type with a word in the name, else in the content."""
    return F.coalesce(*[F.when(s.rlike(p), k) for s in (name, content) for k, p in CLAUSE_TYPES], F.lit("other"))


def clauses(t: Column) -> Column:
    """Array of (sort_order, name, content, clause_type). Where formal headings occur they alone count, else numbered
    lines of at most 60 characters. What stands before the first heading is the basic information. Without headings: one
    clause, the first 5,000 characters. At most 200 clauses."""

    def cut(lines: Column) -> Column:
        formal = F.exists(lines, lambda x: x.rlike(UNICODE + FORMAL))
        numbered = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, UNICODE + p, 0), F.lit("")) for p in NUMBERED])
        head = lambda x: F.when(formal, F.nullif(F.regexp_extract(x, UNICODE + FORMAL, 0), F.lit(""))).when(F.length(strip(x)) <= LINE, numbered(x))
        marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), head(x).alias("head"))), lambda m: m["head"].isNotNull())

        def named(h: Column) -> Column:
            def one(m: Column, j: Column) -> Column:
                line = F.get(lines, m["at"])
                rest = strip(F.substring(line, F.length(m["head"]) + 1, F.length(line)))
                short = F.length(rest) <= TITLE
                body = F.transform(F.slice(lines, m["at"] + 2, F.coalesce(F.get(h, j + 1)["at"], F.size(lines)) - m["at"] - 1), lambda x: F.regexp_replace(x, UNICODE + r"\s+$", ""))
                content = strip(F.array_join(F.when(short, body).otherwise(F.concat(F.array(rest), body)), "\n"))
                name = F.left(F.when(short & (rest != ""), rest).otherwise(strip(m["head"])), F.lit(NAME))
                return F.struct(name.alias("name"), content.alias("content"), type_of(name, content).alias("clause_type"))

            whole = F.left(strip(F.coalesce(t, F.lit(""))), F.lit(HEAD))
            basics = strip(F.array_join(F.transform(F.slice(lines, F.lit(1), F.coalesce(F.get(h, F.lit(0))["at"], F.lit(0))), lambda x: F.regexp_replace(x, UNICODE + r"\s+$", "")), "\n"))
            made = lambda name, content, kind: F.filter(F.array(F.struct(F.lit(name).alias("name"), content.alias("content"), kind.alias("clause_type"))), lambda c: c["content"] != "")
            return F.when(F.size(h) == 0, made(WHOLE, whole, type_of(F.lit(""), whole))).otherwise(F.concat(made(BASICS, basics, F.lit("other")), F.transform(h, one)))

        return bound(marks, named)

    found = F.slice(bound(lines_of(t), cut), 1, CLAUSES)
    return F.transform(found, lambda c, i: F.struct((i + 1).alias("sort_order"), c["name"].alias("name"), c["content"].alias("content"), c["clause_type"].alias("clause_type")))


def reflow(t: Column) -> Column:
    """Lines that go on are joined: not behind an end mark, nor behind or before a key and value, nor before an item. As
    keyed lines always begin anew, whether a line joins depends on it and the line before only."""

    def joined(lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(lines, i - 1)
            apart = (x == "") | x.rlike(KEYED) | x.rlike(ITEM) | (before == "") | before.rlike(KEYED) | before.rlike(ENDED)
            return F.when(i == 0, x).when(apart, F.concat(F.lit("\n"), x)).otherwise(x)

        return F.array_join(F.transform(lines, one), "")

    return bound(F.transform(lines_of(t), strip), joined)


def chunk_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row per chunk: key, chunk_id, index, text, clause_marker, char_count."""
    c = docs.select(key, F.explode(chunks(F.col(text))).alias("c"))
    return c.select(key, F.format_string("%s:%04d", F.coalesce(F.col(key).cast("string"), F.lit("unknown")), F.col("c.index")).alias("chunk_id"), "c.index", "c.text", F.col("c.marker").alias("clause_marker"), F.length("c.text").alias("char_count"))


def normalised_clause(t: Column) -> Column:
    """Blanks between Chinese characters out, brackets around Chinese and commas after it full width, line ends trimmed."""
    cjk = "一-鿿、。，；：？！“”‘’（）"
    t = F.regexp_replace(F.regexp_replace(t, "[ \t　]+", " "), rf"(?<=[{cjk}]) (?=[{cjk}])", "")
    t = F.regexp_replace(t, r"\(([^()]*[一-鿿][^()]*)\)", "（$1）")
    return F.regexp_replace(F.regexp_replace(t, r"(?<=[一-鿿]),(?![0-9])", "，"), r"(?m)[ \t]+$", "")

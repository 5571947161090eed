import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from clausewright.functions import fields, udf
from clausewright.operators import classify, clauses, elements, retrieval
from clausewright.plans import texts  # noqa: F401
from clausewright.plans.catalogue import NEAREST, ORACLES, QUERIES
from clausewright.sources import files

SALE = """智能产品销售合同
合同编号：XS-1
甲方（买方）：甲公司
一、合同标的
标的为智能产品。
二、付款条款
乙方在 3 日内支付 40%
三、争议解决
向法院起诉。"""


def made(spark, f, *texts):
    """The rows that f makes of each text, as tuples."""
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v"))
    return [[tuple(x) for x in r.v] if isinstance(r.v, list) and r.v and not isinstance(r.v[0], str) else r.v for r in d.orderBy("i").collect()]


def test_clauses(spark):
    sale, formal, none, short = made(spark, clauses.clauses, SALE, "第一条 标的\n一、甲\n二、乙\n第二条 保密\n保守秘密", None, "abc")
    assert [c[1] for c in sale] == ["合同基本信息", "合同标的", "付款条款", "争议解决"]
    assert [c[3] for c in sale] == ["other", "main", "payment", "dispute"]
    assert [c[0] for c in sale] == [1, 2, 3, 4] and sale[2][2] == "乙方在 3 日内支付 40%"
    assert [c[1] for c in formal] == ["标的", "保密"]
    assert none == [] and short == [(1, "全文", "abc", "other")]
    (many,) = made(spark, clauses.clauses, "\n".join(f"{i}、甲{i}" for i in range(1, 300)))
    assert len(many) == 200 and many[-1][:2] == (200, "甲200")


def test_bounds(spark):
    text = "前言\n第一条 甲\n2. b\n三、丙\n（四）丁\n保密\n"
    (got, none) = made(spark, clauses.bounds, text, None)
    assert [m for _, _, m in got] == ["第一条", "2", "三", "四", "保密"] and all(text[a:b] == m for a, b, m in got) and none == []


def test_chunks(spark):
    long = "一句话。" * 600
    none, empty, got, marked, short, paras = made(spark, clauses.chunks, None, "", long, "第一条 甲\n" + "x" * 900 + "\n第二条 乙\n短", "短文一段也有十个字以上", "第一段文字有十个字以上\n \n第二段文字有十个字以上")
    assert none == [] and empty == []
    assert all(len(t) <= 800 + 50 + 2 for _, t, _ in got) and [i for i, *_ in got] == list(range(len(got))) and got[0][1].endswith("。")
    assert marked[0][2] == "第一条" and short == [(0, "短文一段也有十个字以上", None)] and paras[0][1] == "第一段文字有十个字以上"


def test_windows_cover(spark):
    t = "".join(f"{i}." for i in range(2000))
    (cut,) = made(spark, lambda c: clauses.windows(c, 100, 10), t)
    assert all(len(p) <= 100 and p.endswith(".") for p in cut) and cut[-1].endswith(t[-5:])
    at = 0
    for p in cut:
        assert (k := t.find(p, max(0, at - 20))) <= at
        at = k + len(p)
    assert at == len(t)


def test_tails(spark):
    rows = {"短": "短", "甲" * 60: "甲" * 50, "甲" * 90 + "。" + "乙" * 8: "乙" * 8, "甲" * 90 + "。" + "乙" * 3: "甲" * 46 + "。乙乙乙"}
    assert made(spark, lambda c: clauses.tail(c, 50), *rows) == list(rows.values())


def test_reflow(spark):
    rows = {"签订\n本合同。\n甲方：张三\n续\n（一）甲\n乙": "签订本合同。\n甲方：张三\n续\n（一）甲乙", "a\n\nb": "a\n\nb", "甲\r\n乙": "甲乙", "": ""}
    assert made(spark, clauses.reflow, *rows) == list(rows.values())


def test_named_in():
    assert udf.named_in("深圳创新电子有限公", "甲方：\n深圳创新电子有限公司") and not udf.named_in("某某集团", "深圳") and not udf.named_in(None, None)


def test_empty_texts(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert clauses.chunk_rows(d, "doc_id").count() == 0
    row = d.select(*[f(F.col("text")).alias(n) for n, f in fields.FILLERS.items()]).collect()
    assert all(v is None for r in row for v in r)
    c = d.selectExpr("doc_id", "text", "null AS title", "cast(null as string) AS model", "cast(null as string) AS arb_type", "cast(null as double) AS arb_conf", "cast(null as string) AS preset")
    assert [(r.type, r.conf) for r in classify.classify(c).collect()] == [("其他", 0.3)] * 2


def test_blocks_of_queries(spark, monkeypatch):
    e = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    few = sorted(map(tuple, retrieval.nearest(e, q, 3).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 7)
    assert sorted(map(tuple, retrieval.nearest(e, q, 3).collect())) == few and len(few) == 180


def test_nearest_of_odd_vectors(spark, monkeypatch):
    """Ties, halves of a step, repeated ids and vectors without a similarity, against the SQL of tk_vector."""
    monkeypatch.setattr(retrieval, "BROADCAST_PARTS", 40)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 5)
    monkeypatch.setattr(retrieval, "FIRST_ROWS", 4)
    made = [(i, [float(i % 7), float(i % 3) - 1, 1.0]) for i in range(90)]
    odd = [(20, None), (100, [0.0, 0.0, 0.0]), (101, [float("nan"), 1.0, 0.0]), (102, [float("inf"), 1.0, 0.0]), (103, None), (None, [1.0, 1.0, 1.0]), (105, [1e-200, 0.0, 1e-200]), (106, [1e200, 0.0, 1e200])]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", made + odd)
    e = spark.createDataFrame(made + odd, "vec_id long, embedding array<double>")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for k in (1, 5, 95, 300):
        got = retrieval.nearest(e, q, k)
        want = con.sql(f"WITH {NEAREST} SELECT query_id, vec_id, sim, r FROM n WHERE r <= {k}").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_nearest_of_other_lengths(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, [1.0, None]), (3, []), (4, [0.6, 0.8])], "vec_id long, embedding array<double>")
    got = retrieval.nearest(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).where("query_id IN (0, 3)"), 3)
    assert sorted(map(tuple, got.collect())) == [(0, 1, None, 2), (0, 2, None, 3), (0, 4, 0.6, 1), (3, 0, None, 1), (3, 1, None, 2), (3, 2, None, 3)]
    assert retrieval.nearest(e, e.limit(0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3).count() == 0


def test_nearest_makes_no_pairs(spark):
    plan = retrieval.nearest(*vectors(spark, 300), 2)._jdf.queryExecution().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_nearest_against_all_pairs(spark):
    e, q = vectors(spark, 4_000)
    got = {}
    for r in retrieval.nearest(e, q, 7).collect():
        got.setdefault(r.query_id, {})[r.r] = (r.vec_id, r.sim)
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 4_000, 20):
        sim = np.round(x @ x[i], 4)
        best = [j for j in np.lexsort((np.arange(4_000), -sim)) if j != i][:7]
        assert got[i] == {n: (j, sim[j]) for n, j in enumerate(best, 1)}


def vectors(spark, n):
    rows = np.random.default_rng(5).normal(size=(n, 6)).tolist()
    e = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def test_title_guess(spark, tmp_path):
    """Figures that are a line's number stay, spaces of any width go, as in its SQL."""
    rows = ["0997 | a", "1\n", " \n12", "\u3000\u00a0甲 \u2003\n乙", "\t x", "\n\n2 b 2", "  ", "\u3000", "", None, "甲" * 50, "\u200b z", "\ra "]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = dict(map(tuple, QUERIES["tx_title_guess"](spark, str(tmp_path)).collect()))
    assert got == dict(con.sql(ORACLES["tx_title_guess"]).select("doc_id", "title").fetchall())
    assert got[0] == "0997 | a" and got[3] == "甲" and got[10] == "甲" * 40


def test_milestones_keep_their_figures(spark):
    (got,) = made(spark, elements.milestones, "05%预付\n 10%验收；25%尾款")
    assert [m[2] for m in got] == [0.05, 0.1, 0.25]


def test_uploads(spark, tmp_path):
    for name, size in (("a.pdf", 0), ("b.pdf", 5), ("c.txt", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.error_code) for r in files.uploads(spark, str(tmp_path)).collect()}
    assert got == {"b.pdf": (5, None)}  # the reader passes empty files over


def test_annotations_and_texts(spark, tmp_path):
    for name, what in (("one", json.dumps({"id": "one", "amount": 2.5})), ("two", json.dumps({"id": "two", "text": "y" * 60})), ("_skipped", "{}"), ("bad", "{")):
        (tmp_path / f"{name}.json").write_text(what)
    (tmp_path / "one.txt").write_text("z" * 60)
    kinds = StructType([StructField("id", StringType()), StructField("amount", DoubleType()), StructField("text", StringType())])
    read = files.annotations(spark, str(tmp_path), kinds)
    assert sorted(r.name for r in read.collect()) == ["one", "two"]
    given = spark.createDataFrame([("two", "short")], "id string, text string")
    assert [(r.id, r.text[0]) for r in files.with_texts(read, given, spark, str(tmp_path)).collect()] == [("one", "z")]


@pytest.mark.parametrize("path, want", [("a.b", 1), ("a.c", None), ("a.b.c", None)])
def test_looked_up(path, want):
    assert files.looked_up({"a": {"b": 1}}, path) == want

"""Blocks of a read page: reading order, seals over them, and statistics by document. A page's blocks are few."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_SHARE, GAP_SHARE = 0.6, 1.8


def page_text(blocks: list[tuple[str, int, int, int, int]]) -> str:
    """The text of blocks (text, x1, y1, x2, y2) in reading order.

    A block starts a row where its centre is more than 0.6 median heights from the row's mean; a gap of more than 1.8
    median heights between the tops of rows is a blank line."""
    if not blocks:
        return ""
    heights = sorted(y2 - y1 for _, _, y1, _, y2 in blocks)
    middle = heights[len(heights) // 2]
    rows: list[list] = []
    mean = 0.0
    for b in sorted(blocks, key=lambda b: (b[2] + b[4]) / 2):
        centre = (b[2] + b[4]) / 2
        if rows and abs(centre - mean) <= ROW_SHARE * middle:
            rows[-1].append(b)
            mean += (centre - mean) / len(rows[-1])
        else:
            rows.append([b])
            mean = centre
    out, top = [], None
    for row in rows:
        own = min(b[2] for b in row)
        if top is not None and own - top > GAP_SHARE * middle:
            out.append("")
        out.append(" ".join(b[0] for b in sorted(row, key=lambda b: b[1])))
        top = own
    return "\n".join(out)


def reading_order(blocks: DataFrame) -> DataFrame:
    """doc_id, page, text of blocks (doc_id, page, text, x1, y1, x2, y2)."""

    def one(key, page: pd.DataFrame) -> pd.DataFrame:
        rows = list(page[["text", "x1", "y1", "x2", "y2"]].itertuples(index=False, name=None))
        return pd.DataFrame([(*key, page_text(rows))], columns=["doc_id", "page", "text"])

    return blocks.groupBy("doc_id", "page").applyInPandas(one, "doc_id long, page int, text string")


def sealed(blocks: DataFrame, seals: DataFrame) -> DataFrame:
    """blocks (doc_id, page, x1 to y2 and others) and whether their centre lies in a seal's box of their page, edges included."""
    boxes = seals.groupBy("doc_id", "page").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_boxes"))
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = F.exists("_boxes", lambda s: x.between(s["x1"], s["x2"]) & y.between(s["y1"], s["y2"]))
    return blocks.join(boxes, ["doc_id", "page"], "left").withColumn("sealed", F.coalesce(inside, F.lit(False))).drop("_boxes")

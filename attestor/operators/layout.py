"""Tokens to lines, page types, quarantine and label/value pairs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from attestor.functions import text as T

LINE = ["case_id", "pass_id", "page_index", "block_num", "paragraph_num", "line_num"]
PAGE = ["case_id", "pass_id", "page_index"]


def group_lines(tokens: DataFrame, keys: Sequence[str] = LINE, order: Sequence[str] = ("word_num",)) -> DataFrame:
    """Lines of tokens: text in word order, box their union, confidence their mean weighted by length (1 at least).

    Columns text, confidence, l, b, r, t of tokens; a null text counts as empty.
    """
    weight = F.greatest(F.lit(1), F.char_length(F.coalesce("text", F.lit(""))))
    words = F.array_sort(F.collect_list(F.struct(*order, F.coalesce("text", F.lit("")).alias("_w"))))
    return tokens.groupBy(*keys).agg(
        F.array_join(F.transform(words, lambda s: s["_w"]), " ").alias("text"),
        (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"),
        F.min("l").alias("l"),
        F.min("b").alias("b"),
        F.max("r").alias("r"),
        F.max("t").alias("t"),
    )


def overlap(a: str, b: str) -> dict[str, Column]:
    """Measures of two boxes with columns a_l, a_b, a_r, a_t and b_...: iou, share of a covered, same_row (value right of label in one row)."""
    c = F.col
    wide = F.greatest(F.lit(0.0), F.least(c(f"{a}_r"), c(f"{b}_r")) - F.greatest(c(f"{a}_l"), c(f"{b}_l")))
    high = F.greatest(F.lit(0.0), F.least(c(f"{a}_t"), c(f"{b}_t")) - F.greatest(c(f"{a}_b"), c(f"{b}_b")))
    size = lambda x, lo, hi: F.greatest(F.lit(0.0), c(f"{x}_{hi}") - c(f"{x}_{lo}"))
    area = lambda x: size(x, "l", "r") * size(x, "b", "t")
    inter = wide * high
    return {
        "iou": F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0)),
        "covered": F.coalesce(F.try_divide(inter, area(a)), F.lit(0.0)),
        "same_row": (high >= 0.5 * F.least(size(a, "b", "t"), size(b, "b", "t"))) & (c(f"{b}_l") >= c(f"{a}_r") - 8),
    }


def same_row_pairs(lines: DataFrame, page: Sequence[str] = PAGE, cell: float = 64.0) -> DataFrame:
    """(page, a_seq, b_seq) of lines of a page where b stands to the right of a in its row.

    A page is dealt by bands of `cell` height: a line is in each band that it
    touches, and a pair is found in the first band that both touch.  So a tall
    page is not joined with itself as a whole.
    """
    banded = lines.select(*page, "line_seq", "l", "b", "r", "t", F.explode(F.sequence(F.floor(F.col("b") / cell).cast("int"), F.floor(F.col("t") / cell).cast("int"))).alias("_band"))
    side = lambda x: banded.select(*page, "_band", F.col("line_seq").alias(f"{x}_seq"), *[F.col(k).alias(f"{x}_{k}") for k in "lbrt"])
    first = F.greatest(F.floor(F.col("a_b") / cell), F.floor(F.col("b_b") / cell)) == F.col("_band")
    return side("a").join(side("b"), [*page, "_band"]).filter((F.col("a_seq") != F.col("b_seq")) & first & overlap("a", "b")["same_row"]).select(*page, "a_seq", "b_seq")


def visual_rows(centres, heights, lefts) -> list[int]:
    """Indices in reading order of lines sorted by centre and left edge: the topmost line left anchors a row, which takes the lines near its centre, from left to right."""
    order, left = [], list(range(len(centres)))
    while left:
        anchor, row, rest = left[0], [left[0]], []
        for i in left[1:]:
            near = abs(centres[i] - centres[anchor]) <= max(4.0, 0.75 * min(heights[anchor], heights[i]))
            (row if near else rest).append(i)
        order += sorted(row, key=lambda i: lefts[i])
        left = rest
    return order


@F.pandas_udf(ArrayType(IntegerType()))
def _visual_rows(centres: pd.Series, heights: pd.Series, lefts: pd.Series) -> pd.Series:
    return pd.Series([visual_rows(c.tolist(), h.tolist(), x.tolist()) for c, h, x in zip(centres, heights, lefts, strict=True)])


def reading_order(lines: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """lines (page keys, line_seq, l, b, r, t and others) with reading_order.

    The greedy rows depend on order, so a page is one array, a bounded thing;
    Python sees three numbers a line, in batches of many pages.
    """
    rest = [c for c in lines.columns if c not in page]
    line = F.struct(((F.col("b") + F.col("t")) / 2).alias("_c"), F.col("l").alias("_x"), F.col("line_seq").alias("_s"), F.struct(*rest).alias("_line"))
    pages = lines.groupBy(*page).agg(F.array_sort(F.collect_list(line)).alias("_all"))
    height = F.transform("_all", lambda x: F.greatest(F.lit(1.0), x["_line"]["t"] - x["_line"]["b"]))
    pages = pages.withColumn("_o", _visual_rows(F.transform("_all", lambda x: x["_c"]), height, F.transform("_all", lambda x: x["_x"])))
    return pages.select(*page, "_all", F.posexplode("_o").alias("reading_order", "_i")).select(*page, F.get("_all", F.col("_i"))["_line"].alias("_l"), "reading_order").select(*page, "_l.*", "reading_order")


def page_types(lines: DataFrame, page: Sequence[str] = PAGE, order: str = "line_seq") -> DataFrame:
    """Type of each page by its first four lines."""
    heads = lines.groupBy(*page).agg(F.slice(F.array_sort(F.collect_list(F.when(F.col(order) < 4, F.struct(order, "text")))), 1, 4).alias("_h"))
    return heads.select(*page, T.page_type(F.array_join(F.transform("_h", lambda s: s["text"]), " ")).alias("page_type"))


def quarantine(lines: DataFrame, hit: Column, page: Sequence[str] = PAGE, order: str = "line_seq", window: int = 12) -> DataFrame:
    """lines with quarantined: a context hit takes its line and the next window - 1."""
    by = Window.partitionBy(*page).orderBy(order).rowsBetween(-(window - 1), 0)
    return lines.withColumn("quarantined", F.max(F.coalesce(hit, F.lit(False)).cast("int")).over(by) == 1)


def pair_values(lines: DataFrame, label: Column, page: Sequence[str] = PAGE, order: str = "line_seq") -> DataFrame:
    """(page, order, field, value) of bare labels and the line right after: one that is accepted and no label.  lines has text and accepted."""
    by = Window.partitionBy(*page).orderBy(order)
    marked = lines.withColumn("_label", F.when(F.col("accepted"), label))
    marked = marked.withColumn("_before", F.lag("_label").over(by))
    return marked.filter(F.col("_before").isNotNull() & F.col("accepted") & F.col("_label").isNull()).select(*page, order, F.col("_before").alias("field"), F.trim("text").alias("value"))


def running_value(lines: DataFrame, value: Column, scope: Column, page: Sequence[str] = PAGE, order: str = "line_seq", name: str = "applicant_hint") -> DataFrame:
    """lines with the last non-null value so far on the page, forgotten where the scope (a non-null case id) changes."""
    by = Window.partitionBy(*page).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_scope", F.last(scope, ignorenulls=True).over(upto))
    lines = lines.withColumn("_new", F.coalesce(F.col("_scope") != F.lag("_scope").over(by), F.lit(False)).cast("int"))
    lines = lines.withColumn("_part", F.sum("_new").over(upto))
    inside = Window.partitionBy(*page, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(inside)).drop("_scope", "_new", "_part")

"""Several values packed in one text cell: finding the delimiters, splitting, positions.

Which candidates separate values in a source is inferred from all its cells.
Cells are reduced to shapes (runs of letters and digits become one sign) and
counted, so scoring runs over the few different shapes.  A candidate is scored
by what happens without it: if pieces then lose the usual type of the source,
or cells fall into pieces of less consistent number, it does separate values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.common import SPACE, cut, quoted

#: Candidate delimiters; white space around a sign belongs to it.
CANDIDATES = (",", ";", "|", "/", " ")
#: Least score of a candidate that separates values.
LEAST_SCORE = 0.0


def _class(signs: Sequence[str]) -> str:
    return "[" + "".join("\\" + s for s in signs if s != " ") + "]"


def delimiter_pattern(signs: Sequence[str]) -> str:
    """Regular expression of one delimiter out of ``signs``; a blank stands for white space alone."""
    marks = [s for s in signs if s != " "]
    parts = ([f"{SPACE}*{_class(marks)}{SPACE}*"] if marks else []) + ([f"{SPACE}+"] if " " in signs else [])
    return "|".join(parts) or "(?!)"


def split_cell(cell: Column, signs: Sequence[str], quotes: bool = True) -> Column:
    """The values of a cell as an array, empty ones included, so that an index is a position.

    Nothing separates within a pair of quotes or between ``<`` and ``>``; the
    quotes go, the brackets stay.  An unpaired quote is an ordinary sign.  With
    ``quotes=False`` quotes mean nothing and are dropped wherever they stand.
    Null gives null; white space at the ends of the cell means nothing.
    """
    text = cell if quotes else F.regexp_replace(cell, "[\"']", "")
    text = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    kept = "\"([^\"]*)\"|'([^']*)'|(<[^>]*>)" if quotes else "()()(<[^>]*>)"
    text = F.regexp_replace(text, f"{kept}|({delimiter_pattern(signs)})", "\u0002$1$2$3\u0003$4\u0004")
    text = F.regexp_replace(text, "\u0002\u0003[^\u0004]+\u0004", "\u0001")
    return F.split(F.regexp_replace(text, "[\u0002\u0003\u0004]", ""), "\u0001", -1)


def _shape(cell: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(cell, "<[^>]*>", "<>"), r"[^\s\p{Z},;|/\"'<>:]+", "A")
    return F.regexp_replace(bare, f"^{SPACE}+|{SPACE}+$", "")


def infer_delimiters(cells: DataFrame, source: str, cell: str, quotes: str) -> DataFrame:
    """Scores of every candidate per source: columns ``source``, ``sign``, ``cells``, ``score``.

    ``cells`` counts the cells that hold the candidate outside quotes and
    brackets.  The score is the share of pieces of the source's most frequent
    type when all candidates split, less that share when all but this one do
    (type regularity), plus half of what the spread of piece counts relative
    to their mean gains (count consistency).  Null and blank cells don't count.
    """
    # rows with equal shape behave alike: score each shape once, by its weight; the few shapes are read twice, the cells once
    shapes = cells.where(quoted(cell).isNotNull()).groupBy(quoted(source).alias("source"), quoted(quotes).alias("__q"), _shape(quoted(cell)).alias("__s")).agg(F.count(F.lit(1)).alias("__w"))
    shapes = cut(shapes)

    def pieces(signs: Sequence[str]) -> Column:
        return F.filter(F.when(F.col("__q"), split_cell(F.col("__s"), signs)).otherwise(split_cell(F.col("__s"), signs, quotes=False)), lambda x: x != "")

    split = shapes.withColumn("__all", pieces(CANDIDATES)).where(F.size("__all") > 0)
    kinds = split.select("source", "__w", F.explode("__all").alias("__p")).groupBy("source", "__p").agg(F.sum("__w").alias("__c"))
    usual = kinds.groupBy("source").agg(F.max_by("__p", F.struct("__c", "__p")).alias("__usual"))
    out = []
    for sign in CANDIDATES:
        without = pieces([s for s in CANDIDATES if s != sign])
        out.append(F.struct(F.lit(sign).alias("sign"), without.alias("without")))
    each = split.join(F.broadcast(usual), "source").select("source", "__w", "__all", "__usual", F.explode(F.array(*out)).alias("__o")).select("source", "__w", "__all", "__usual", "__o.*")
    each = each.where(F.size("without") != F.size("__all"))
    fits = lambda a: F.size(F.filter(a, lambda x: x == F.col("__usual")))
    w, n, m = F.col("__w"), F.size("__all"), F.size("without")
    spread = lambda k: F.sqrt(F.greatest(F.lit(0.0), F.sum(w * k * k) / F.sum(w) - F.pow(F.sum(w * k) / F.sum(w), F.lit(2)))) / (F.sum(w * k) / F.sum(w))
    regular = F.sum(w * fits(F.col("__all"))) / F.sum(w * n) - F.sum(w * fits(F.col("without"))) / F.sum(w * m)
    return each.groupBy("source", "sign").agg(F.sum("__w").alias("cells"), (regular + F.lit(0.5) * F.greatest(F.lit(0.0), spread(m) - spread(n))).alias("score"))


def _split_by_source(source: Column, cell: Column, quotes: Column, scores: list) -> Column:
    """The values of a cell as an array, split by the delimiters that ``scores`` finds in its source."""
    signs: dict[str, list[str]] = {}
    for r in scores:
        if r["score"] > LEAST_SCORE:
            signs.setdefault(r["source"], []).append(r["sign"])
    by_signs: dict[tuple[str, ...], list[str]] = {}
    for s, found in signs.items():
        by_signs.setdefault(tuple(c for c in CANDIDATES if c in found), []).append(s)
    split = F.when(F.lit(False), F.array().cast("array<string>"))
    for found, sources in by_signs.items():
        for q in (True, False):
            split = split.when(source.isin(sources) & (quotes == F.lit(q)), split_cell(cell, found, q))
    return split.when(quotes, split_cell(cell, [])).otherwise(split_cell(cell, [], False))


def unpack(df: DataFrame, source: str, keep: Sequence[str], cell: str, quotes: str, scores: list | None = None) -> DataFrame:
    """One row per non-empty value: columns ``keep``, ``pos`` (from 1), ``item``.

    Delimiters are inferred per value of ``source`` (a bounded number of
    sources: one row per source and candidate comes to the driver).  ``quotes``
    names a boolean column: false where quotes mean nothing.  Null, empty and
    blank cells give no row.
    """
    if scores is None:
        scores = infer_delimiters(df, source, cell, quotes).collect()
    split = _split_by_source(quoted(source), quoted(cell), quoted(quotes), scores)
    rows = df.where(quoted(cell).isNotNull()).select(*(quoted(k) for k in keep), F.posexplode(split).alias("__p", "item"))
    return rows.where(F.col("item") != "").select(*(quoted(k) for k in keep), (F.col("__p") + 1).cast("int").alias("pos"), "item")


def rewritten(df: DataFrame, cell: str, sign: str, quotes: bool = True, empty: bool = True) -> DataFrame:
    """``df`` with the cells of one column, written in any notation, in one: values joined by ``sign``, null as it is.

    The column is one source, whose delimiters are inferred from all its cells.
    ``empty=False`` leaves empty values out, else they keep their position.
    """
    one = df.select(F.lit(cell).alias("source"), quoted(cell).alias("cell"), F.lit(quotes).alias("quotes"))
    scores = infer_delimiters(one, "source", "cell", "quotes").collect()
    values = _split_by_source(F.lit(cell), quoted(cell), F.lit(quotes), scores)
    return df.withColumn(cell, F.array_join(values if empty else F.filter(values, lambda x: x != ""), sign))


def first_position(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first value of every key, by position."""
    order = Window.partitionBy(*(quoted(k) for k in keys)).orderBy("pos", "item")
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")

"""Mixing sources to target weights: raking and calibrated sampling, DataFrame functions only.

Token counts are summed to cells of source, language and topic. Iterative
proportional fitting finds one factor for each source, language and topic so that
the cells' weights meet the target share of every margin: each step sums the
weights of one margin and sets its factors to target over sum. A document's
probability follows its cell's weight over its cell's tokens; it is scaled so
that the expected tokens are the wanted fraction, where cells that would exceed 1
stay at 1 and the rest takes up their part.

Only cells and factors take part in the iteration. Sums combine on the map side,
so that a source with a third of all rows is no larger than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.llm.graph import small
from tidemark.runtime import stage

MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
MISSING = "(null)"
SWEEPS = 8
SWEEPS_A_WRITE = 4
FRACTION = 0.3
FILLS = 4  # rounds that fix cells at probability 1

# Shares wanted of each topic; sources and languages are tempered: share ~ tokens ** power.
TOPIC_SHARES = {"prose": 0.80, "short": 0.08, "table": 0.06, "symbols": 0.04, "shouting": 0.02}
POWERS = {"source": 0.5, "lang": 0.7}


def topic(text: Column) -> Column:
    """The kind of text: symbols, table, shouting, short or prose (null: short)."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)

    def without(mark: str) -> Column:
        return size - F.length(F.replace(text, F.lit(mark), F.lit("")))

    return (F.when(without("###") + without("$$$") + without("%%%") > size * 0.03, "symbols")
            .when(without("|") > size * 0.02, "table")
            .when(without("!!") > size * 0.05, "shouting")
            .when(size < 200, "short").otherwise("prose"))


def tokens(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _over(margin: str) -> WindowSpec:
    return Window.partitionBy(margin)


def with_targets(cells: DataFrame) -> DataFrame:
    """Cells that have tokens, with `share_<margin>`: the wanted share of tokens of their
    source, language and topic. The shares of the values that have any tokens sum to 1."""
    cells = cells.where("n > 0")
    wanted = F.create_map(*[F.lit(x) for pair in TOPIC_SHARES.items() for x in pair])
    for m in MARGINS:
        part = wanted[F.col("topic")] if m == "topic" else F.pow(F.sum("n").over(_over(m)), F.lit(POWERS[m]))
        cells = cells.withColumns({f"part_{m}": part, f"cells_{m}": F.count("*").over(_over(m))})
    cells = stage(cells)
    total = cells.agg(*[F.sum(F.col(f"part_{m}") / F.col(f"cells_{m}")).alias(m) for m in MARGINS]).first()
    return cells.select(*MARGINS, "n", *[(F.col(f"part_{m}") / (total[m] or 1.0)).alias(f"share_{m}") for m in MARGINS])


def rake(cells: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with `weight`, whose margins approach the targets; the last margin meets its own.

    A step scales the weights of a margin's value by target over sum; sums are
    windows over the cells, so a step neither joins nor broadcasts. Cells without
    tokens are left out. Targets that no weights can meet (a value found in no
    fitting cell) are approached as far as the sweeps go: `residual` tells.
    """
    out = with_targets(cells).withColumn("weight", F.col("n").cast("double"))
    for k in range(1, sweeps + 1):
        for m in MARGINS:
            out = out.withColumn("weight", F.col("weight") * F.col(f"share_{m}") / F.sum("weight").over(_over(m)))
        if k % SWEEPS_A_WRITE == 0:
            out = stage(out)
    return stage(out)


def residual(raked: DataFrame) -> DataFrame:
    """(margin, value, wanted, reached): shares of tokens of every value after raking."""
    parts = [raked.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(
        F.first(f"share_{m}").alias("wanted"), F.sum("weight").alias("reached")) for m in MARGINS]
    return reduce(DataFrame.unionByName, parts)


def calibrate(cells: DataFrame, fraction: float = FRACTION, sweeps: int = SWEEPS) -> DataFrame:
    """(source, lang, topic, probability) of every cell that has tokens."""
    raked = rake(cells, sweeps)
    rate = F.col("weight") / F.col("n")
    budget = fraction * (raked.agg(F.sum("n")).first()[0] or 0)
    scale = None
    for _ in range(FILLS + 1):
        full = F.lit(False) if scale is None else rate * scale >= 1
        row = raked.agg(F.sum(F.when(full, F.col("n")).otherwise(0)).alias("fixed"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if row.free:
            scale = (budget - row.fixed) / row.free
    return raked.select(*MARGINS, F.least(F.lit(1.0), rate * (scale or 0.0)).alias("probability"))


def draw(doc_id: Column, seed: int = 0) -> Column:
    """A fixed uniform number in [0, 1) for each id, from its MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_probability(rows: DataFrame, probability: DataFrame) -> DataFrame:
    """Attach `probability` and `sampled` to rows that carry the margins.

    Cells are broadcast up to a counted bound; beyond it the join shuffles. Rows of
    a cell without tokens get probability 0.
    """
    out = rows.join(small(stage(probability)), list(MARGINS), "left")
    out = out.withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return out.withColumn("sampled", draw(F.col("doc_id")) < F.col("probability"))


def _margins(text_col: str, source_col: str, lang_col: str) -> dict[str, Column]:
    return {"source": F.coalesce(F.col(source_col).cast("string"), F.lit(MISSING)),
            "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit(MISSING)), "topic": topic(F.col(text_col))}


def mix_sources(docs: DataFrame, fraction: float = FRACTION, sweeps: int = SWEEPS, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Sampling probability and draw of every document.

    Returns one row per input row: `doc_id`, `source`, `lang`, `topic`,
    `n_tokens`, `probability` (6 decimals), `sampled`. A null source or language
    is the value `(null)`; a null or empty text has no tokens and topic `short`,
    and takes its cell's probability. A null id is drawn as one id. Repeated rows
    share their draw. An empty table gives no rows. Other columns are not read.
    """
    margins = _margins(text_col, source_col, lang_col)
    light = stage(docs.select(F.col(id_col).alias("doc_id"), *(c.alias(m) for m, c in margins.items()),
                              tokens(F.col(text_col)).alias("n_tokens")))
    cells = stage(light.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")))
    out = with_probability(light, calibrate(cells, fraction, sweeps))
    return out.select("doc_id", *MARGINS, "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def sample_mix(docs: DataFrame, fraction: float = FRACTION, sweeps: int = SWEEPS, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The sampled rows with their columns in a struct `row`, margins, tokens and probability."""
    margins = _margins(text_col, source_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(m) for m, c in margins.items()),
                       F.struct("*").alias("row"))
    count = tokens(F.col("row").getField(text_col))
    cells = stage(rows.groupBy(*MARGINS).agg(F.sum(count).alias("n")))
    drawn = with_probability(rows, calibrate(cells, fraction, sweeps)).where("sampled")
    return drawn.select("doc_id", *MARGINS, count.alias("n_tokens"), F.round("probability", 6).alias("probability"),
                        "row")

"""Quality rules with thresholds that follow each language and source.

Everything here is DataFrame expressions: no Python code runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._names import Named
from ._scratch import materialize, small

# White space, symbol characters, base limits.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Metrics that get thresholds, as whole numbers: thousandths, but hundredths of a
#: character for the mean word length.
METRICS = ("symbols_pm", "upper_pm", "marks_pm", "dup_lines_pm", "repeats_pm", "word_len_c")
#: A document is an outlier above ``median + FENCE * max(q75 - median, STEP)``.
FENCE = 6
STEP = {"symbols_pm": 4, "upper_pm": 30, "marks_pm": 15, "dup_lines_pm": 60, "repeats_pm": 50, "word_len_c": 60}
#: Bits of a value that its bin of the quantile sketch keeps: below ``2**BIN_BITS`` (all
#: thousandths, and words of up to 81 code points) a bin is one value, from there on its
#: width doubles with the value.  There is no last bin.
BIN_BITS = 13


def words_of(text: Column) -> Column:
    """Words: maximal runs of anything but blanks and 0x09-0x0D."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Repeated words are counted inside the row: the hashes of the three-word windows are
    sorted with their positions, equal neighbours mark repeated windows, and each marked
    window covers up to three words that no later one covers.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn("_words", words_of(text))
    window = F.transform(
        F.sequence(F.lit(1), F.size("_words") - 2),
        lambda i: F.struct(F.xxhash64(F.element_at("_words", i), F.element_at("_words", i + 1),
                                      F.element_at("_words", i + 2)).alias("h"), i.alias("i")))
    docs = docs.withColumn("_sorted", F.sort_array(F.when(F.size("_words") > 3, window).otherwise(F.array())))
    rows = F.size("_sorted")
    near = F.zip_with(
        F.slice("_sorted", 1, F.greatest(rows - 1, F.lit(0))), F.slice("_sorted", 2, F.greatest(rows, F.lit(1))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    docs = docs.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull())))))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("sum"), F.lit(-9).alias("last")),
        lambda s, i: F.struct((s["sum"] + F.least(i - s["last"], F.lit(3))).alias("sum"), i.alias("last")),
        lambda s: s["sum"])
    docs = docs.withColumn("_line", F.filter(F.split(text, "\n"), lambda line: _without(line, SPACES) != ""))
    docs = docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(_without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        "_lines": F.size("_line"),
        "n_dup_lines": (F.size("_line") - F.size(F.array_distinct("_line"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    })
    return docs.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def with_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))

    def share(part: Column, whole: Column, scale: int = 1000) -> Column:
        return F.when(whole > 0, F.floor(F.lit(scale) * part / whole)).otherwise(F.lit(0)).cast("long")

    chars, upper = F.col("word_chars"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return docs.withColumns({
        "symbols_pm": share(F.col("n_symbols"), chars),
        "upper_pm": share(F.length(text) - F.length(_without(text, upper)), chars),
        "marks_pm": share(F.length(text) - F.length(_without(text, "!?")), chars),
        "dup_lines_pm": share(F.col("n_dup_lines"), F.col("_lines")),
        "repeats_pm": share(F.col("n_repeat_words"), F.col("n_words")),
        "word_len_c": share(chars, F.col("n_words"), 100),
    })


def bin_of(value: Column) -> Column:
    """The least value of the bin of a whole number from 0 on."""
    value = value.cast("long")
    drop = F.length(F.bin(value)) - BIN_BITS
    wide = F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)
    return F.when(value < 2**BIN_BITS, value).otherwise(wide)


def quantile_sketches(docs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mergeable sketches: how many documents of a group have a metric in each bin.

    Bins have fixed edges, so sketches of any parts add up to that of the whole, in any
    order; a quantile is off by less than one bin, at most a 4,096th of it at any length.
    A group has ``2**BIN_BITS`` bins a metric at most, and half as many for each doubling
    from there on, however many documents it has, and partial counts are made before the
    shuffle.  Columns: the groups, metric, bin, n.
    """
    metrics = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), bin_of(F.col(m)).alias("bin")) for m in METRICS]))
    return (docs.select(*groups, metrics.alias("m")).groupBy(*groups, "m.metric", "m.bin")
            .agg(F.count("*").alias("n")))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketches of all parts together."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per group with ``max_<metric>`` for each metric."""
    key = Window.partitionBy(*groups, "metric")
    run = F.sum("n").over(key.orderBy("bin"))
    ranked = sketches.select(*groups, "metric", "bin", run.alias("run"), F.sum("n").over(key).alias("all"))
    cut = ranked.groupBy(*groups, "metric").agg(
        F.min(F.when(2 * F.col("run") >= F.col("all"), F.col("bin"))).alias("q50"),
        F.min(F.when(4 * F.col("run") >= 3 * F.col("all"), F.col("bin"))).alias("q75"))
    step = F.create_map(*[F.lit(x) for kv in STEP.items() for x in kv])[F.col("metric")]
    cut = cut.withColumn("top", F.col("q50") + FENCE * F.greatest(F.col("q75") - F.col("q50"), step))
    return cut.groupBy(*groups).agg(*[
        F.max(F.when(F.col("metric") == m, F.col("top"))).alias(f"max_{m}") for m in METRICS])


def judge_quality(docs: DataFrame, text_col: str = "text", groups: Sequence[str] = ("lang", "source"),
                  source_of_sketches: DataFrame | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """Adds the base columns and ``kept`` to ``docs`` (or to its columns ``carry`` only).

    A document is kept unless it fails a base rule (fewer than 50 words, or more than
    half of its words in repeated three-word windows) or one of its metrics (symbols,
    capitals, exclamation and question marks, repeated lines, repeated words, word
    length) is far above what its own language and source show: above
    ``median + 6 * max(q75 - median, step)``.  The quantiles come from mergeable
    sketches of all documents that pass the base rules, or from stored ones
    (``source_of_sketches``); the thresholds are joined back and compared with the
    metrics' bins: a table of one row per group, broadcast up to 100,000 groups.

    Null text counts as empty and fails.  Null groups form groups of their own; a group
    without thresholds has base rules only.  Repeated rows are judged alike and count
    in the sketches as often.  An empty table stays empty.  Columns may have any names;
    those with the names of added ones are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *METRICS]
    named = Named(docs, added, carry)
    keys = [named.plain(g) for g in groups]
    measured = with_metrics(base_columns(named.df, named.plain(text_col)), named.plain(text_col))
    measured = materialize(measured.select(*dict.fromkeys([*named.kept, *keys]), *added[:6], *METRICS))
    if source_of_sketches is None:
        limits = thresholds(quantile_sketches(measured.where(~F.col("base_failed")), keys), keys)
        limits = limits.toDF(*[f"_g{k}" for k in range(len(keys))], *[f"_max_{m}" for m in METRICS])
    else:
        limits = thresholds(source_of_sketches, groups).toDF(*[f"_g{k}" for k in range(len(keys))], *[f"_max_{m}" for m in METRICS])
    on = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(keys)]
    fits = F.lit(True)
    for m in METRICS:
        fits = fits & (bin_of(F.col(m)) <= F.coalesce(F.col(f"_max_{m}"), F.lit(2**40)))
    out = measured.join(small(limits), on, "left").withColumn("kept", ~F.col("base_failed") & fits)
    return named.back(out, *added)

"""Quality rules with thresholds learnt from the corpus, by language and source.

Every document gets exact counts from its whole text. Four measures of the documents that
pass the base rules go into log-linear histogram sketches (a bucket keeps the six leading
bits of a value, so a quantile is off by 1/32 of its value at most), one sketch for each
language and source. Sketches merge by adding counts, so they are pre-aggregated before
the shuffle and do not depend on how rows were dealt.

A group's limit for a measure is a high quantile of its own sketch, and as many distances
between that quantile and the median further as the measure's margin says; for the mean
word length also a low one. `prior_rows` rows' worth of the language's limit are mixed
into it, and as many of the whole corpus's into that, so small groups lean on their
language. No limit is a fixed number: only levels and margins are parameters. The limits
are joined back and decide.

Most texts have no symbols, so a quantile of their share is often the least value and says
nothing. A share is therefore that of the text and `PRIOR_CHARS` characters without
symbols, and not under one symbol in these: a text with one symbol, whatever its length, is
like one with none. The limit is then where the sketch falls into two classes: the cut with
the greatest variance between their mean logarithms, in the middle of its gap, unless the
quantile limit lies higher. A group whose quantile is the least share and that has no
second class takes its language's limit, and this the corpus's; where none has one,
symbols don't decide.

Only built-in functions run here.

Defined cases: a null or empty text has no words, so it fails the base rules; null
languages and sources are groups of their own; repeated documents each count, and ties
share a bucket; very long texts are counted whole inside their row; a group without a
document that passes the base rules has no limit and needs none; an empty table gives no
row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, stash

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
GRAM = 5
#: Characters without symbols that count beside a text's own, so that a few symbols of a short text say little.
PRIOR_CHARS = 1000
#: Measure -> expression in whole millionths of the counts.
MEASURES = {
    "word_length": "word_chars * 1000000 div greatest(n_words, 1)",
    "symbols": f"greatest(n_symbols * 1000000 div (word_chars + {PRIOR_CHARS}), 1000000 div {PRIOR_CHARS})",
    "dup_lines": "n_dup_lines * 1000000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000000 div greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Level:
    """Which quantiles limit a measure, in thousandths, and how many distances to the median are added.

    With `least`, the value of most rows, the cut between two classes is a limit too, and a quantile there is none.
    """

    high: int
    margin: int = 0
    low: int | None = None
    least: int | None = None


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    most_repeat_percent: int = 20
    #: Junk text may make up less than a tenth of a group, and by its symbols less than a quarter: it must not move the limits.
    levels: tuple[tuple[str, Level], ...] = (
        ("word_length", Level(900, 2, 10)),
        ("symbols", Level(750, 3, least=1_000_000 // PRIOR_CHARS)),
        ("dup_lines", Level(995)),
        ("repeats", Level(995)),
    )
    #: Rows of the language that count beside a group's own, and of the corpus beside a language's.
    prior_rows: int = 200


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of `text`.

    The repeated windows of a text are found inside its row. A text whose windows all
    differ costs one hash set; in the others (hash, position) pairs are sorted, and the
    words that windows with an equal neighbour cover are added up: a window at p that
    follows one at q adds min(5, p - q) words.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*keep, text.alias("_text"))
    d = d.withColumns(
        {
            "_words": F.array_remove(F.split(F.translate("_text", SPACES[1:], " " * 5), " ", -1), ""),
            "_lines": F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
            "word_chars": F.length(F.translate("_text", SPACES, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        }
    )
    d = d.withColumn("n_words", F.size("_words").cast("long")).withColumn("n_lines", F.size("_lines").cast("long"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines")))
    windows = F.when(
        F.col("n_words") >= GRAM,
        F.transform(F.sequence(F.lit(1), (F.col("n_words") - (GRAM - 1)).cast("int")), lambda i: F.xxhash64(F.slice("_words", i, GRAM))),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_windows", windows)
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    repeated = F.filter(
        F.col("_ordered"),
        lambda x, i: (F.get("_ordered", i - 1)["h"] == x["h"]) | (F.get("_ordered", i + 1)["h"] == x["h"]),
    )
    places = F.array_sort(F.transform(repeated, lambda x: x["p"]))
    covered = F.aggregate(
        F.col("_places"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-GRAM).alias("q")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(GRAM), p - a["q"])).alias("n"), p.alias("q")),
        lambda a: a["n"],
    )
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    d = d.withColumn("_ordered", F.when(some, ordered).otherwise(none))
    d = d.withColumn("_places", places).withColumn("n_repeat_words", covered)
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def base_failed(r: Rules) -> Column:
    return (F.col("n_words") < r.least_words) | (100 * F.col("n_repeat_words") > r.most_repeat_percent * F.col("n_words"))


def bucket(v: Column) -> Column:
    """Least value of v's bucket: v with all but its six leading bits cleared."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, top, n): the mergeable sketch of each group and measure; top is the greatest value of a bucket."""
    rows = counts.select("lang", "source", F.explode(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])).alias("measure", "_v"))
    shift = F.greatest(F.length(F.bin(F.col("_v"))) - 6, F.lit(0))
    top = bucket(F.col("_v")) + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1
    return rows.groupBy("lang", "source", "measure", bucket(F.col("_v")).alias("bucket"), top.alias("top")).agg(F.count("*").alias("n"))


def _limits(sketch: DataFrame, keys: list[str], r: Rules) -> DataFrame:
    """(keys, measure, rows, low, high) from each group's own sketch; a quantile is the least bucket whose cumulated count reaches the level."""
    merged = sketch.groupBy(*keys, "measure", "bucket", "top").agg(F.sum("n").alias("n"))
    shift = F.greatest(F.length(F.bin(F.col("bucket"))) - 6, F.lit(0))
    merged = merged.withColumn("_log", F.col("n") * (32 * shift + F.call_function("shiftright", F.col("bucket"), shift)))  # 32 buckets for each power of two
    by = Window.partitionBy(*keys, "measure")
    ordered = by.orderBy("bucket")
    upto = lambda c: F.sum(c).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select(
        *keys, "measure", "bucket", "top", upto("n").alias("upto"), F.sum("n").over(by).alias("rows"),
        upto("_log").alias("log_upto"), F.sum("_log").over(by).alias("logs"), F.lead("bucket").over(ordered).alias("next"),
    )
    apart = F.expr("CASE WHEN next IS NOT NULL THEN log_upto / CAST(upto AS DOUBLE) - (logs - log_upto) / CAST(rows - upto AS DOUBLE) END")
    ranked = ranked.withColumn("_apart", apart).withColumn("between", F.expr("CAST(upto AS DOUBLE) * (rows - upto) * (_apart * _apart)"))
    cut = F.max_by(F.expr("CAST(floor(sqrt(CAST(top AS DOUBLE) * next)) AS BIGINT)"), F.struct("between", -F.col("bucket")))
    of = lambda get: F.create_map(*[F.lit(x) for m, level in r.levels for x in (m, get(level))])[F.col("measure")]
    reach = lambda level, value: F.min(F.when(F.col("upto") * 1000 >= F.col("rows") * level, F.col(value)))
    found = ranked.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"), reach(F.lit(500), "bucket").alias("mid"), reach(of(lambda x: x.low or 0), "bucket").alias("lo"),
        reach(of(lambda x: x.high), "top").alias("hi"), reach(of(lambda x: x.high), "bucket").alias("from"), cut.alias("cut"),
    )
    margin, least = of(lambda x: x.margin), of(lambda x: -1 if x.least is None else x.least)
    low = F.col("lo") - margin * (F.col("mid") - F.col("lo"))
    high = F.when(F.col("from") > least, F.col("hi") + margin * F.greatest(F.col("hi") - F.col("mid"), F.lit(0)))
    return found.select(*keys, "measure", "rows", low.alias("low"), F.when(least < 0, high).otherwise(F.greatest(high, "cut")).alias("high"))


def thresholds(sketch: DataFrame, r: Rules) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high) for each group of the sketch."""
    named = lambda d, of: d.select(*[F.col(c).alias(f"{of}_{c}") for c in d.columns])
    own, lang, whole = (_limits(sketch, keys, r) for keys in (["lang", "source"], ["lang"], []))
    q = own.join(named(lang, "_l"), F.col("lang").eqNullSafe(F.col("_l_lang")) & (F.col("measure") == F.col("_l_measure")))
    q = q.join(F.broadcast(named(whole, "_w")), F.col("measure") == F.col("_w_measure"))  # a row for each measure
    mixed = lambda n, x, y: F.coalesce(F.call_function("div", n * x + r.prior_rows * y, n + r.prior_rows), x, y)
    limit = lambda c: mixed(F.col("rows"), F.col(c), mixed(F.col("_l_rows"), F.col(f"_l_{c}"), F.col(f"_w_{c}")))
    q = q.select("lang", "source", "measure", limit("low").alias("low"), limit("high").alias("high"))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return q.groupBy("lang", "source").agg(*[pick(m, c) for m, level in r.levels for c in (("high",) if level.low is None else ("low", "high"))])


def judge_quality(docs: DataFrame, r: Rules = Rules()) -> DataFrame:
    """One row for each document (doc_id, text, lang, source): the counts, base_failed, kept, and the four measures."""
    counts = text_counts(docs, "doc_id", "lang", "source")
    counts = stash(counts.select("*", *[F.expr(e).alias(m) for m, e in MEASURES.items()], base_failed(r).alias("base_failed")), "text-counts")
    limits = stash(thresholds(stash(sketches(counts.where("not base_failed")), "sketches"), r), "limits")
    judged = join_small(counts, limits, ["lang", "source"])
    inside = ~F.col("base_failed")
    for m, level in r.levels:
        inside = inside & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if level.low is not None:
            inside = inside & (F.col(m) >= F.col(f"{m}_low"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.coalesce(inside, F.lit(False)).alias("kept"), "n_lines", *MEASURES,
    )

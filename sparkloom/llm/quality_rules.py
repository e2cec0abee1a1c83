"""Operator 6: quality rules by distribution divergence, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import WORD, staged, words

#: Frequent short words by language, most frequent first.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los"),
}
N_COMMON = 8
#: Character classes of the histogram; what is left over is lower-case ASCII letters and the rest.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "other": r"[^\x00-\x7F]", "mark": r"[.,;:!?'\"()-]", "symbol": "[#*$%&|<>]"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once a row and hands it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words of an array that lie in a 3-word window found twice or more.

    Windows are hashed (64 bits); only a text in which some hash repeats sorts its (hash,
    position) pairs, marks equal neighbours, and counts the words that marked windows cover.
    """

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            flag = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return F.sort_array(F.filter(flag, lambda p: p.isNotNull()))

        def width(p: Column) -> Column:
            step = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        return let(pairs, lambda s: let(marked(s), width))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    some = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))
    return F.when(F.size(w) < 4, 0).otherwise(some).cast("long")


def base_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: counts of the fixed rules, and the two histograms, without the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), text.alias("t"))
    t = F.col("t")
    src = src.withColumn("w", words(t))
    w = F.col("w")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    own = F.coalesce(
        *[F.when(F.col("lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()],
        F.array().cast("array<string>"),
    )
    src = src.withColumn("own", own)
    hits = F.filter(F.transform(w, lambda x: F.array_position(F.col("own"), F.lower(x))), lambda p: p > 0)
    count = lambda k: lambda h: F.size(F.filter(h, lambda p: p == k)).cast("double")
    common = let(hits, lambda h: F.array(*[count(k)(h) for k in range(1, N_COMMON + 1)], (F.size(w) - F.size(h)).cast("double")))
    return src.select(
        "doc_id", "lang",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(t).alias("n_text"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        F.when(F.size("own") > 0, common).alias("word_hist"),
        *[F.regexp_count(t, F.lit(p)).cast("long").alias(f"c_{k}") for k, p in CLASSES.items()],
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms; 0 if one is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def divergence(sp: Column, sq: Column) -> Column:
        terms = F.zip_with(
            p, q, lambda a, b: (part(a / sp, (a / sp + b / sq) / 2) + part(b / sq, (a / sp + b / sq) / 2)) / 2
        )
        return F.sqrt(F.greatest(F.lit(0.0), total(terms)))

    return F.when((total(p) > 0) & (total(q) > 0), divergence(total(p), total(q))).otherwise(F.lit(0.0))


def counted(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, min_words: int, repeat_percent: int) -> DataFrame:
    """``base_rules`` in the shared folder, with ``base_failed`` and the character histogram."""
    seen = staged(base_rules(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    named = [f"c_{k}" for k in CLASSES]
    space = F.col("n_text") - F.col("word_chars")
    rest = F.col("word_chars") - sum((F.col(c) for c in named[1:]), F.col(named[0]))
    hist = F.array(*[F.col(c).cast("double") for c in named], space.cast("double"), F.greatest(rest, F.lit(0)).cast("double"))
    return seen.withColumn("base_failed", failed).withColumn("char_hist", hist)


def _means(rows: DataFrame, *by: Column) -> DataFrame:
    share = lambda h, k, n: F.avg(F.get(F.col(h), F.lit(k)) / F.col(n))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_ref"),
        F.array(*[share("char_hist", k, "n_text") for k in range(len(CLASSES) + 2)]).alias("ref_char"),
        F.array(*[share("word_hist", k, "n_words") for k in range(N_COMMON + 1)]).alias("ref_word"),
    )


def language_references(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, repeat_percent: int = 50
) -> DataFrame:
    """References for ``judge`` from a table of trusted texts: a row a language, and one of null for all."""
    ok = counted(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, min_words=min_words, repeat_percent=repeat_percent).filter("not base_failed")
    return _means(ok, F.col("lang").alias("ref_lang")).union(_means(ok, F.lit(None).cast("string").alias("ref_lang")))


def judge(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50,
    repeat_percent: int = 50, max_char: float = 0.25, max_word: float = 0.55, max_both: float = 0.38,
    prior: int = 20, references: DataFrame | None = None,
) -> DataFrame:
    """Contract columns, then js_char and js_word, one row for each row of ``docs``.

    Every text is read once, where it lies; its counts go to the shared folder. ``references`` are
    those of ``language_references``; without them, the mean histograms (each document weighing the
    same, so that no huge one sets them) of all documents of ``docs`` that pass the base rules. A
    language's reference is its own mean and the mean of all languages, the latter weighing as much
    as ``prior`` documents, so that rare languages pass to their own norm by degrees; a language
    without a word list has no word distance. A text is kept if both distances and their sum are
    within the limits. Guard: texts under ``min_words`` words fail the base and get no verdict.
    Null or empty texts have 0 words and fail; a null language is a language of its own.
    """
    seen = counted(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, min_words=min_words, repeat_percent=repeat_percent)
    ok = seen.filter(~F.col("base_failed"))
    if references is None:
        by_lang, whole = _means(ok, F.col("lang").alias("ref_lang")), _means(ok)
    else:
        by_lang, whole = references.filter("ref_lang is not null"), references.filter("ref_lang is null")
    whole = whole.filter("n_ref > 0").select(F.col("ref_char").alias("all_char"), F.col("ref_word").alias("all_word"))
    # One row: the mean over all languages.
    joined = seen.join(by_lang, F.col("lang") == F.col("ref_lang"), "left").join(F.broadcast(whole), how="left")
    empty = F.array().cast("array<double>")

    def mixed(own: str, every: str) -> Column:
        n = F.coalesce("n_ref", F.lit(0))
        both = F.zip_with(F.coalesce(own, every), F.col(every), lambda a, b: (n * F.coalesce(a, b) + prior * b) / (n + prior))
        return F.coalesce(F.when(~F.exists(both, lambda x: x.isNull()), both), empty)

    joined = joined.withColumn("ref_char", mixed("ref_char", "all_char"))
    joined = joined.withColumn("ref_word", F.when(F.col("word_hist").isNotNull(), mixed("ref_word", "all_word")))
    out = joined.withColumn("js_char", js_distance(F.col("char_hist"), F.col("ref_char")))
    own = js_distance(F.col("word_hist"), F.col("ref_word"))
    out = out.withColumn("js_word", F.when(F.col("word_hist").isNotNull(), own).otherwise(0.0))
    fits = (F.col("js_char") <= max_char) & (F.col("js_word") <= max_word)
    fits = fits & (F.col("js_char") + F.col("js_word") <= max_both)
    return out.select(
        "doc_id", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & fits).alias("kept"), "js_char", "js_word",
    )

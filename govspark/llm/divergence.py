"""Quality rules: distance of a document's histograms from those of the languages.

Two histograms describe a text: its character classes, and how often it uses each of the most
common words of the languages. The references are the same histograms of all documents of a
language. A document's distance is the Jensen-Shannon distance (base 2, 0 to 1) to the reference
that is nearest. Texts shorter than the guards are not judged by that histogram.

A text with fewer common words than the guard asks for has the rest in a bin of other words, which
no reference has: without any common word it has the largest distance. It is judged if it is so
long that a text of any of the languages would have as many common words as the guard asks for.

All of it is native expressions. Null and empty texts have no words and fail the base rules.
Documents with a null language, or with one outside ``languages``, shape no reference and are
judged like the others. If no language has a reference, nothing is judged by it. Each row, a
repeated one too, has its own result. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.llm.common import SPACE, WORD, materialise

#: Character classes: characters outside the class, one class after the other.
CLASSES = {
    "lower": "[^a-z]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "space": r"[^ \t-\r]+",
    "stop": r"[^.,;:!?'\"-]+", "wide": r"[\x00-\x7F]+",
}
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Parameters of the verdict. References are languages times common words at most, as literals of the plan."""

    languages: tuple[str, ...] = ("de", "en", "es", "fr")
    common_words: int = 64
    #: Distances above these fail.
    most_class_distance: float = 0.45
    most_word_distance: float = 0.85
    #: Texts with fewer characters, or too short for so many common words, are not judged.
    least_chars: int = 200
    least_common: int = 20
    least_words: int = 20
    most_repeated_percent: int = 30


def words(text: Column) -> Column:
    """Words between ASCII white space. Plain replacements and a one-character split use no regex."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def bind(value: Column, body) -> Column:
    """A value computed once, for an expression that uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more, the first included."""
    n = F.size(w) - (width - 1)
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(w, i, width), " ").alias("s"), i.alias("i")))

    def places(ordered: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(ordered, i)["s"] == F.get(ordered, j)["s"], F.lit(False))

        twice = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(twice, lambda i: F.get(ordered, i)["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    # Most texts repeat no window. Hashes of windows, each made of those of two halves, tell so
    # without a string or a sort: equal windows have equal hashes. Strings decide the others.
    def joined(of: Column, step: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(of) - 1 - step), lambda i: F.xxhash64(F.get(of, i), F.get(of, i + step)))

    def repeats(hashes: Column) -> Column:
        return F.size(F.array_distinct(hashes)) < F.size(hashes)

    single = F.transform(w, lambda x: F.xxhash64(x))
    hashed = bind(single, lambda a: bind(joined(a, 1), lambda b: bind(joined(b, 2), lambda c: repeats(joined(c, 4)))))
    heavy = bind(F.sort_array(windows), lambda ordered: bind(places(ordered), covered))
    return F.when(n < 2, 0).when(hashed, heavy).otherwise(0).cast("long")


def base_columns(docs: DataFrame, rules: Rules) -> DataFrame:
    """Counts of each document: the base rules and the character classes."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    kept = F.length(F.regexp_replace(text, SPACE + "+", ""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("w", words(text))
    out = rows.select(
        "doc_id", "lang", "w", F.length("text").cast("long").alias("n_chars"),
        F.size("w").cast("long").alias("n_words"),
        kept.cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        *[F.length(F.regexp_replace(text, outside, "")).cast("long").alias(f"class_{c}") for c, outside in CLASSES.items()],
    )
    known = sum((F.col(f"class_{c}") for c in CLASSES), F.lit(0))
    failed = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeated_percent * F.col("n_words")
    )
    return out.withColumns({"class_other": F.col("n_chars") - known, "base_failed": failed})


def half_term(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.log2(2 * x / (x + y)) / 2).otherwise(F.lit(0.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def class_distance(reference: list[float]) -> Column:
    """Jensen-Shannon distance of the row's character classes from a reference."""
    square = F.lit(0.0)
    for name, q in zip((*CLASSES, "other"), reference):
        p = F.col(f"class_{name}") / F.greatest(F.col("n_chars"), F.lit(1))
        square = square + half_term(p, F.lit(q)) + half_term(F.lit(q), p)
    return F.sqrt(F.greatest(F.lit(0.0), square))


def shares_of(used: Column, least: int) -> Column:
    """Each common word of a text with its share, from all of its common words one by one.

    What a text has less than ``least`` counts as other words, which are not listed.
    """
    n, whole = F.size(used), F.greatest(F.size(used), F.lit(least))

    def shares(ordered: Column) -> Column:
        firsts = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        )
        return bind(
            firsts,
            lambda at: F.transform(
                at,
                lambda i, k: F.struct(
                    F.get(ordered, i).alias("word"), ((F.coalesce(F.get(at, k + 1), n) - i) / whole).alias("p")
                ),
            ),
        )

    return F.when(n > 0, bind(F.sort_array(used), shares)).otherwise(F.array().cast("array<struct<word:string,p:double>>"))


def word_distance(shares: Column, reference: dict[str, float]) -> Column:
    """Jensen-Shannon distance of a text's common words from a reference.

    What the text lacks of the reference adds half of its share, and so do its other words; only
    the common words of the text have to be looked up.
    """
    listed = F.create_map(*[F.lit(x) for pair in reference.items() for x in pair])
    pairs = F.transform(
        shares, lambda s: F.struct(s["p"].alias("p"), F.coalesce(F.element_at(listed, s["word"]), F.lit(0.0)).alias("q"))
    )
    square = F.transform(pairs, lambda s: half_term(s["p"], s["q"]) + half_term(s["q"], s["p"]) - s["q"] / 2)
    other = 1 - total(F.transform(shares, lambda s: s["p"]))
    return F.sqrt(F.greatest(F.lit(0.0), total(square) + 0.5 + other / 2))


def word_references(docs: DataFrame, rules: Rules) -> dict[str, dict[str, float]]:
    """The most common words of each language with their share among these, from all documents."""
    spoken = docs.select(F.col("lang").cast("string").alias("lang"), F.explode(words(F.col("text").cast("string"))).alias("word"))
    counts = spoken.filter(F.col("lang").isin(*rules.languages)).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # The most common of each part first, so that no task sees all words of a language.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(256))).orderBy(F.desc("n"), "word")
    best = counts.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= rules.common_words)
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = best.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= rules.common_words)
    lists: dict[str, dict[str, float]] = {}
    for row in top.orderBy("lang", "r").collect():  # languages times common words at most
        lists.setdefault(row["lang"], {})[row["word"]] = row["n"]
    return {lang: {w: n / sum(found.values()) for w, n in found.items()} for lang, found in lists.items()}


def class_references(base: DataFrame, rules: Rules) -> list[list[float]]:
    """Share of each character class in all texts of each language."""
    names = [f"class_{c}" for c in (*CLASSES, "other")]
    sums = base.filter(F.col("lang").isin(*rules.languages)).groupBy("lang")
    rows = sums.agg(*[F.sum(c).alias(c) for c in names], F.sum("n_chars").alias("n")).filter("n > 0")
    return [[row[c] / row["n"] for c in names] for row in rows.orderBy("lang").collect()]  # one row per language


def length_guard(base: DataFrame, rules: Rules) -> Column:
    """Words from which a text of any of the languages would have the least number of common words."""
    sums = base.filter(F.col("lang").isin(*rules.languages)).groupBy("lang").agg(F.sum("n_common").alias("c"), F.sum("n_words").alias("n"))
    least = sums.filter("c > 0").agg(F.min(F.col("c") / F.col("n"))).first()[0]
    return F.lit(rules.least_common / least if least else None).cast("double")


def nearest(distances: list[Column]) -> Column:
    return F.least(*distances) if len(distances) > 1 else distances[0] if distances else F.lit(None).cast("double")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Base counts, both distances and the verdict of each document."""
    lists = word_references(docs, rules)
    common = sorted({w for found in lists.values() for w in found})
    used = F.filter("w", lambda w: w.isin(*common)) if common else F.array().cast("array<string>")
    rows = base_columns(docs, rules).withColumn("used", used).drop("w")
    rows = rows.withColumns({"n_common": F.size("used").cast("long"), "shares": shares_of(F.col("used"), rules.least_common)}).drop("used")
    rows = rows.withColumn("word_distance", nearest([word_distance(F.col("shares"), q) for q in lists.values()]))
    base = materialise(rows.drop("shares"), "divergence")
    rows = base.withColumn("class_distance", nearest([class_distance(q) for q in class_references(base, rules)]))
    far = (F.col("n_chars") >= rules.least_chars) & (F.col("class_distance") > rules.most_class_distance)
    long = F.coalesce(F.col("n_words") >= length_guard(base, rules), F.lit(False))
    judged = long | (F.col("n_common") >= rules.least_common)
    strange = judged & (F.col("word_distance") > rules.most_word_distance)
    failed = F.coalesce(far, F.lit(False)) | F.coalesce(strange, F.lit(False))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~failed).alias("kept"), "class_distance", "word_distance",
    )

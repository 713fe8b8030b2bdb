"""Source divergence audit: how far the sources of a language differ in their use of its terms.

Every term of a language is a row of a matrix of indicators with a column for each (source, level),
a level being how often the source uses a term. The product of the matrix's transpose with the
matrix is the joint table of any two sources: how many terms have this level here and that one
there. A distance that depends on the two levels alone is priced on these tables, not on terms.

Products are made in blocks: terms in groups by hash and there by how common they are, so that a
block has few levels, and sources in column blocks. Block products are exact, as no entry exceeds the terms of a
block. Level 0 has no column: a product's diagonal holds each source's own levels, and what they
leave of all terms has level 0. So the work follows the entries that are not zero.

Null texts, languages and sources are ''. Rows repeated with one id are documents of their own.
Each (language, source) that occurs has its rows, without any term too; a language of one source
has no pairs. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.llm import shards
from govspark.llm.common import materialise, utf8


@dataclass(frozen=True)
class Settings:
    """Parameters of the audit.

    ``group`` terms go to a task at once, and ``sources`` to a column block. A block has ``terms``
    terms, fewer (``least_terms`` at least) where they have more than ``columns`` columns.
    """

    least_documents: int = 10
    scale: int = 1_000_000_000
    prior: int = 2
    top: int = 10
    group: int = 2048
    sources: int = 32
    terms: int = 512
    least_terms: int = 32
    columns: int = 1024


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shards.gathered(batches):
        offsets, data = utf8(batch.column("text"))
        counts, words = shards.split(offsets, data, shards.LETTER, shards.LOWER)
        codes, distinct = shards.coded(words)
        group, groups = shards.coded(batch.column("group"))
        width = max(1, len(distinct))
        rows = np.repeat(np.arange(len(counts)), counts)
        cells, times = np.unique(rows * width + codes, return_counts=True)
        row, term = np.divmod(cells, width)
        cells, place = np.unique(group[row] * width + term, return_inverse=True)
        n = np.bincount(place, times, len(cells)).astype(np.int64)
        docs = np.bincount(place, minlength=len(cells)).astype(np.int64)
        owner, term = np.divmod(cells, width)
        yield pa.RecordBatch.from_arrays(
            [groups.take(pa.array(owner)).cast(pa.string()), distinct.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs)],
            names=["group", "term", "n", "docs"],
        )


def named(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms that a language keeps.

    ``first`` marks one row of each (lang, term). Counts of a batch of documents are shuffled
    once, by language and term; all that follows finds them together.
    """
    # Language and source travel as one text: the language's length, both after it.
    both = F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), F.col("source")).alias("group")
    part = named(docs).select(both, "text").mapInArrow(_counted, "group string, term string, n long, docs long")
    size = F.substring_index("group", ":", 1)
    rest = F.expr("substr(group, length(substring_index(group, ':', 1)) + 2)")
    part = part.withColumns({"size": size.cast("int"), "rest": rest}).select(
        F.substring("rest", F.lit(1), F.col("size")).alias("lang"), F.expr("substr(rest, size + 1)").alias("source"), "term", "n", "docs"
    )
    counts = part.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    counts = counts.withColumns(
        {
            "lang_n": F.sum("n").over(word),
            "df": F.sum("docs").over(word),
            "first": F.row_number().over(word.orderBy("source")) == 1,
        }
    )
    return counts.filter(F.col("df") >= s.least_documents).drop("df", "docs")


def group_totals(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms) of every group that occurs."""
    groups = named(docs).select("lang", "source").distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"))
    none = F.lit(0).cast("long")
    return groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "terms")]
    )


def divided(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(n: Column, total: Column, s: Settings) -> Column:
    """Scaled share of a count, at least 1; null in a language without terms."""
    above = F.lit(s.scale).cast("decimal(10,0)") * (n + s.prior).cast("decimal(19,0)")
    below = (total + s.prior * F.col("terms")).cast("decimal(20,0)")
    return 1 + divided(above, F.when(below > 0, below))


def distance(p: Column, q: Column) -> Column:
    return divided((p - q) * (p - q), p + q)


def _products(s: Settings) -> Callable:
    """Joint levels of the sources of two column blocks, over some terms of all languages."""

    def run(key: tuple, entries: pa.Table) -> pa.Table:
        left, right = key[1].as_py(), key[2].as_py()
        columns = {c: entries[c].combine_chunks() for c in entries.column_names}
        lang = columns["lang"].dictionary_encode().indices.to_numpy().astype(np.int64)
        term = columns["term"].dictionary_encode().indices.to_numpy()
        source = columns["source"].dictionary_encode().indices.to_numpy().astype(np.int64)
        common, level, part = (columns[c].to_numpy() for c in ("lang_n", "n", "part"))
        # Terms of a language one by one, those equally common side by side: they have few levels.
        order = np.lexsort((term, common, lang))
        new = np.diff(lang[order], prepend=-1).astype(bool) | np.diff(term[order], prepend=-1).astype(bool)
        row = np.cumsum(new) - 1
        starts = np.append(np.flatnonzero(new), len(order))
        borders = row[np.flatnonzero(np.diff(lang[order], prepend=-1))].tolist() + [len(starts) - 1]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first, last in zip(borders[:-1], borders[1:]):
            while first < last:
                height = min(s.terms, last - first)
                while True:
                    at = order[starts[first] : starts[first + height]]
                    cells = source[at] << 40 | level[at]
                    names, example, code = np.unique(cells, return_index=True, return_inverse=True)
                    if len(names) <= s.columns or height <= s.least_terms:
                        break
                    height = max(s.least_terms, height // 2)
                rows = row[starts[first] : starts[first + height]] - first
                found.append(_product(at, rows, height, example, code, part[at], source[at], left, right))
                first += height
        x, y, n = (np.concatenate(c) for c in zip(*found))
        i, j = pa.array(x), pa.array(y)
        own = {c: columns[c].take(i) for c in ("lang", "source", "p", "zero")} | {"level": columns["n"].take(i)}
        other = {f"item_{c}": columns[c].take(j) for c in ("p", "zero")} | {"item": columns["source"].take(j), "item_level": columns["n"].take(j)}
        return pa.table(own | other | {"terms": pa.array(n)}).select(_JOINT_NAMES)

    return run


def _product(at, rows, height, example, code, part, source, left, right):
    """Entries of one block: an entry of the input for each of the two columns, and their product."""

    def indicators(which: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(part[example] == which)
        place = np.full(len(example), -1)
        place[own] = np.arange(len(own))
        mine = place[code] >= 0
        out = np.zeros((height, len(own)), np.float32)
        out[rows[mine], place[code[mine]]] = 1
        return out, example[own]

    a, firsts = indicators(left)
    b, seconds = (a, firsts) if left == right else indicators(right)
    product = a.T @ b
    x, y = np.nonzero(product)
    n = product[x, y].astype(np.int64)
    if left == right:  # each pair of sources once, and each source's own levels
        keep = source[firsts[x]] <= source[seconds[y]]
        x, y, n = x[keep], y[keep], n[keep]
    return at[firsts[x]], at[seconds[y]], n


_JOINT = (
    "lang string, source string, level long, p long, zero long,"
    "item string, item_level long, item_p long, item_zero long, terms long"
)
_JOINT_NAMES = [c.split()[0] for c in _JOINT.split(",")]


def joint_tables(priced: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Entries of all joint tables, by block of terms: how many have ``level`` here, ``item_level`` there.

    Levels are 1 or more. Any two sources of a language come once, in one of their two orders. A
    source with itself gives how many terms have each level.
    """
    most = F.max("n").alias("n")
    sizes = priced.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("terms"))
    sizes = sizes.groupBy("lang").agg(F.count("*").alias("n"), F.sum("terms").alias("terms")).agg(most, F.sum("terms").alias("terms")).first()
    groups, parts = (sizes["terms"] or 0) // s.group + 1, (sizes["n"] or 0) // s.sources + 1
    word, part = F.xxhash64("lang", "term"), F.pmod(F.xxhash64("source"), F.lit(parts)).alias("part")
    rows = priced.select("lang", "source", "term", "n", "lang_n", "p", "zero", part, F.pmod(word, F.lit(groups)).alias("group"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")), lambda o: F.struct(F.least("part", o).alias("left"), F.greatest("part", o).alias("right")))
    rows = rows.withColumn("m", F.explode(met)).select("group", "m.left", "m.right", "part", "lang", "source", "term", "n", "lang_n", "p", "zero")
    return rows.groupBy("group", "left", "right").applyInArrow(_products(s), _JOINT)


def audit(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Ranked distances of each (lang, source): to the other sources, and its terms above the language."""
    counts = materialise(term_counts(docs, s), "term-levels")
    groups = materialise(group_totals(docs, counts), "term-groups")
    zero = price(F.lit(0).cast("long"), F.col("total"), s)
    groups = groups.withColumn("zero", zero)
    priced = counts.join(groups, ["lang", "source"]).withColumns(
        {"p": price(F.col("n"), F.col("total"), s), "q": price(F.col("lang_n"), F.col("lang_total"), s)}
    )
    here, there, base = F.col("p"), F.col("item_p"), F.col("zero")
    # What a pair of levels is away from what level 0 on either side would give.
    both = distance(here, there) - distance(here, F.col("item_zero")) - distance(base, there) + distance(base, F.col("item_zero"))
    same = F.col("source") == F.col("item")
    tables = joint_tables(priced, s).groupBy("lang", "source", "item", F.when(same, F.col("p")).alias("p"), F.when(same, base).alias("zero"))
    tables = materialise(tables.agg(F.sum("terms").alias("terms"), F.sum(F.col("terms") * both).alias("value")), "joint-tables")

    # All pairs of a language's sources are the result itself.
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), "terms")
    different = F.col("source") != F.col("item")
    empty = F.coalesce(F.col("terms") * distance(base, F.col("item_zero")), F.lit(0))
    none = groups.select("lang", "source", "zero").join(others, "lang").filter(different).select("lang", "source", "item", empty.alias("value"))
    own = tables.filter(same).select("lang", "source", "p", "zero", F.col("terms").alias("m")).join(others.drop("terms"), "lang").filter(different)
    gain = F.sum(F.col("m") * (distance(here, F.col("item_zero")) - distance(base, F.col("item_zero")))).alias("value")
    own = own.groupBy("lang", "source", "item").agg(gain)
    joint = tables.filter(different).select("lang", "source", "item", "value")
    one_way = own.unionByName(joint)
    turned = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = none.unionByName(one_way).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    above = priced.filter(here > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(here, F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= s.top)
    return pairs.unionByName(terms)

"""Mixing sources to target weights by budgets of tokens in a tree.

The tree has domains, languages in a domain, and sources in a language. The whole budget is a
share of all tokens. A node's budget is divided among its children by weight; what a child cannot
use, because its documents times the allowed epochs have fewer tokens, goes to its siblings by
weight, and only what no sibling can use goes to the siblings of the parent.

A leaf goes through its documents in epochs, each in an order of its own that a seed decides. It
takes as many whole epochs as its budget holds and then the documents at the beginning of the next
one, whole, as long as their tokens fit. Documents with equal hashes (repeated rows) are taken
together or not at all.

Tokens are words between ASCII white space. Null and empty texts have none and are taken where
their place in the order is. Null languages and sources are children of their own, written as an
empty text; sources of no domain belong to ``rest``. Unlisted names have the default weight.
A weight of 0 gets nothing. An empty table gives no rows. Columns of the documents are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govspark.llm.common import SPACE, materialise

LEAF = ("domain", "lang", "source")
#: Leaves up to which their table is broadcast (under 100 bytes a row); beyond, it is joined by shuffle.
BROADCAST_LEAVES = 50_000
#: Documents of a leaf that stand in one range of its order.
RANGE_DOCS = 4096


@dataclass(frozen=True)
class Mix:
    share: float = 0.6
    epochs: int = 2
    seed: int = 17
    default: float = 1.0
    rest: str = "rest"
    domains: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "web": tuple(f"src{i}" for i in range(10)),
            "books": tuple(f"src{i}" for i in range(10, 15)),
            "forum": tuple(f"src{i}" for i in range(15, 19)),
        }
    )
    #: Weights of the children of each level, by name.
    weights: dict[str, dict[str, float]] = field(
        default_factory=lambda: {
            "domain": {"web": 4.0, "books": 3.0, "forum": 2.0, "rest": 1.0},
            "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
            "source": {"src0": 2.0},
        }
    )


def lookup(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def words(text: Column) -> Column:
    """Number of words: runs of other characters than white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE + "+"), "")), F.lit(0)).cast("long")


def place(doc_id: Column, epoch: Column, seed: int) -> Column:
    """60 bits that decide the place of a document in an epoch."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed)), epoch.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def leaf_columns(mix: Mix) -> dict[str, Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    domain_of = {s: d for d, sources in mix.domains.items() for s in sources}
    return {
        "__domain": lookup(source, domain_of, mix.rest),
        "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "__source": source,
    }


def divided(children: DataFrame, parents: list[str], level: str, mix: Mix) -> DataFrame:
    """Children with ``budget``: the parent's, by weight, up to each child's ``room``.

    Children sorted by room per weight: one is full if the parent's budget covers all before it
    and the same room per weight for it and all behind it. The others share what is left.
    """
    weight = lookup(F.col(level), mix.weights.get(level, {}), mix.default).cast("double")
    rows = children.withColumn("w", weight).filter("w > 0").withColumn("ratio", F.col("room") / F.col("w"))
    ordered = Window.partitionBy(*parents).orderBy("ratio", level)
    before, behind = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"used": F.coalesce(F.sum("room").over(before), F.lit(0)), "w_left": F.sum("w").over(behind)})
    rows = rows.withColumn("full", F.col("used") + F.col("ratio") * F.col("w_left") <= F.col("parent_budget") * (1 + 1e-12))
    all_ = Window.partitionBy(*parents)
    rest = F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(all_)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(all_)
    budget = F.when(F.col("full"), F.col("room").cast("double")).otherwise(rest * F.col("w") / open_weight)
    return rows.withColumn("budget", budget).drop("w", "ratio", "used", "w_left", "full", "parent_budget")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaves (domain, lang, source, docs, tokens) with ``budget``, from the root down."""
    leaves = leaves.withColumn("room", F.col("tokens") * mix.epochs)
    domains = leaves.groupBy("domain").agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"))
    whole = Window.partitionBy()  # one row per domain: as many as the parameters name, and the rest
    top = domains.withColumn("parent_budget", F.sum("tokens").over(whole) * mix.share).drop("tokens")
    top = divided(top, [], "domain", mix).select("domain", F.col("budget").alias("parent_budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("room").alias("room")).join(top, "domain")
    langs = divided(langs, ["domain"], "lang", mix).select("domain", "lang", F.col("budget").alias("parent_budget"))
    return divided(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", mix)


def cuts(about: DataFrame, mix: Mix) -> DataFrame:
    """By leaf: whole epochs, and the last place taken in the epoch behind them."""
    leaves = about.groupBy(*LEAF).agg(F.count("*").alias("docs"), F.sum("tokens_of").alias("tokens"))
    budget = F.floor(F.col("budget") + 1e-6).cast("long")
    planned = leaf_budgets(materialise(leaves, "budget-leaves"), mix).select(
        *LEAF, "docs", budget.alias("budget"),
        F.when(F.col("tokens") > 0, F.floor(budget / F.col("tokens"))).otherwise(0).cast("int").alias("whole"), "tokens",
    )
    planned = planned.withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens"))
    planned = materialise(planned.withColumn("ranges", F.ceil(F.col("docs") / RANGE_DOCS)), "budget-plan")
    rows = about.join(by_leaf(planned), list(LEAF)).withColumn("place", place(F.col("doc_id"), F.col("whole"), mix.seed))
    rows = rows.withColumn("range", F.floor(F.col("place") / F.lit(float(1 << 60)) * F.col("ranges")).cast("long"))
    # Ranges before the one in which the budget ends, then the documents of that one.
    before = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*LEAF, "range", "left").agg(F.sum("tokens_of").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    border = sums.filter(F.col("before") + F.col("n") > F.col("left")).groupBy(*LEAF, "left").agg(
        F.min("range").alias("range"), F.min("before").alias("before")
    )
    inside = rows.select(*LEAF, "range", "place", "tokens_of").join(by_leaf(border), [*LEAF, "range"])
    run = Window.partitionBy(*LEAF).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("sum", F.col("before") + F.sum("tokens_of").over(run)).filter(F.col("sum") <= F.col("left"))
    last = taken.groupBy(*LEAF).agg(F.max("place").alias("last"))
    ends = border.select(*LEAF, "range").join(last, list(LEAF), "left")
    return planned.select(*LEAF, "whole", "ranges").join(
        # Without a border range everything left fits; without a document taken in it, all ranges before it.
        ends, list(LEAF), "left"
    ).select(
        *[F.col(c).alias(f"__{c}") for c in LEAF], F.col("whole").alias("__whole"), F.col("ranges").alias("__ranges"),
        F.col("range").alias("__range"), F.coalesce("last", F.lit(-1)).alias("__last"),
    )


def by_leaf(leaves: DataFrame) -> DataFrame:
    """A table with one row per leaf, broadcast if it has few rows."""
    few = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return F.broadcast(leaves) if few else leaves


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The chosen documents, once for each epoch that takes them, with ``domain`` and ``epoch``.

    The two replace columns of the same names.
    """
    named = docs.drop("domain", "epoch").withColumns(leaf_columns(mix))
    about = materialise(
        named.select(
            *[F.col(f"__{c}").alias(c) for c in LEAF], F.col("doc_id").cast("long").alias("doc_id"),
            words(F.col("text").cast("string")).alias("tokens_of"),
        ),
        "budget-docs",
    )
    ends = materialise(cuts(about, mix), "budget-cuts")
    rows = named.join(by_leaf(ends), [f"__{c}" for c in LEAF])
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__whole"))))
    here = place(F.col("doc_id").cast("long"), F.col("epoch"), mix.seed)
    part = F.floor(here / F.lit(float(1 << 60)) * F.col("__ranges")).cast("long")
    taken = (
        (F.col("epoch") < F.col("__whole"))
        | F.col("__range").isNull()
        | (part < F.col("__range"))
        | ((part == F.col("__range")) & (here <= F.col("__last")))
    )
    return rows.filter((F.col("epoch") < mix.epochs) & taken).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("domain", "epoch")], F.col("__domain").alias("domain"), "epoch"
    )

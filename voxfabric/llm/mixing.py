"""Mixing sources to target weights: budgets down a domain-language-source tree, then a token-prefix of seeded epochs per leaf.

DataFrame functions only. The tree has one row per leaf; documents are read
once for their token counts and once for the result, and their texts are
never shuffled: each leaf's prefix becomes one cut point in the seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfabric.llm.common import WORD, cut, text_column, whole

LEVELS = ("domain", "lang", "source")
#: Largest leaf table that is sent to all tasks (about 100 bytes a leaf).
BROADCAST_LEAVES = 100_000
SALTS = 32
#: Hexadecimal digits of the seeded order by which the end of a leaf's prefix is narrowed down.
SLOT_DIGITS = (2, 4, 6)


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Divide each parent's budget among its children (columns budget, cap, weight): column share.

    Children get shares in proportion to their weights, but none more than its
    cap; what one cannot take goes to its siblings by weight. In the order of
    cap/weight the capped children come first, so running sums find them.
    """
    ordered = Window.partitionBy(*parents).orderBy(F.expr("cast(cap as double) / nullif(weight, 0)").asc_nulls_last(), name)
    family = Window.partitionBy(*parents)
    before = F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    full = _whole(F.col("cap")) * after <= _whole(F.col("budget") - before) * F.col("weight")
    marked = nodes.withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(family)
    marked = marked.withColumn("left", left).withColumn("open", open_weight)
    part = F.expr("coalesce(cast(left as decimal(28,0)) * cast(weight as decimal(9,0)) div nullif(open, 0), 0L)")
    return marked.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long")).drop("full", "left", "open")


def budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """domain, lang, source, tokens, share of each leaf.

    A node can take max_epochs times the tokens below it. Shares are found from
    the root down with these caps, which has a shortage taken up by siblings
    first, and by the ancestors' siblings only where the siblings are full.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    upper: list[str] = []
    shares = None
    for depth, level in enumerate(LEVELS):
        at = [*upper, level]
        nodes = caps.groupBy(*at).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        nodes = nodes.withColumn("budget", F.lit(total).cast("long")) if shares is None else nodes.join(shares, upper)
        shares = fill(nodes, upper, level).select(*at, F.col("share").alias("budget"))
        upper = at
    return leaves.join(shares, list(LEVELS)).withColumnRenamed("budget", "share")


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch's seeded order, hexadecimal."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _on_leaves(rows: DataFrame, leaves: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Join by leaf: broadcast where the leaves were counted and are few, else with salted keys."""
    keys = [f"__{x}" for x in LEVELS]
    if few:
        return rows.join(F.broadcast(leaves), keys, how)
    salted = leaves.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.hash("__id"), F.lit(SALTS))).join(salted, [*keys, "__salt"], how).drop("__salt")


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, int]],
    fraction: tuple[int, int] = (1, 1),
    max_epochs: int = 1,
    seed: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    epoch: str | None = "mix_epoch",
) -> DataFrame:
    """docs with the column that epoch names, mix_epoch: the rows chosen, once per epoch. Without a name, docs' columns alone.

    A token is a run of characters other than ASCII white space. The total is
    fraction (numerator, denominator) of all tokens. weights gives per level
    ("domain", "lang", "source") the whole-number weights of names, 1 where it
    has none. A leaf's share is so many whole epochs and a prefix, by tokens,
    of the next epoch's seeded order. Null domains, languages and sources
    count as one of name "none"; null texts have no tokens. Leaves without
    tokens are kept once. Rows that repeat an id in a leaf stand or fall
    together; documents of equal order stand by id. Texts of any length are
    counted whole. An empty table gives an empty result. An input column of
    epoch's name is replaced, others may have any names. Rounding leaves at most
    one token a node unused, and a leaf's prefix ends before the first document
    that exceeds it, which leaves less than that document's tokens.
    """
    given = docs.drop(epoch) if epoch else docs
    keyed = given.select(  # the input's columns in one struct, so that none of their names can clash
        whole(given, "__row"), domain.alias("__domain"), F.col(lang).alias("__lang"), F.col(source).alias("__source"), F.col(doc_id).alias("__id"), text_column(text).alias("__text")
    )
    keyed = keyed.withColumns({f"__{x}": F.coalesce(F.col(f"__{x}").cast("string"), F.lit("none")) for x in LEVELS})
    keys = [f"__{x}" for x in LEVELS]
    counted = cut(keyed.select(*keys, "__id", F.regexp_count("__text", F.lit(WORD)).cast("long").alias("__n")))

    leaves = counted.groupBy(*[F.col(k).alias(x) for k, x in zip(keys, LEVELS)]).agg(F.sum("__n").alias("tokens"))
    leaves = cut(leaves)
    every = leaves.agg(F.sum("tokens"), F.count("*")).first()
    total, few = (every[0] or 0) * fraction[0] // fraction[1], every[1] <= BROADCAST_LEAVES
    shares = budgets(leaves, total, weights, max_epochs)
    epochs = F.when(F.col("tokens") == 0, F.lit(1)).otherwise(F.expr("share div nullif(tokens, 0)"))
    shares = shares.select(*[F.col(x).alias(k) for k, x in zip(keys, LEVELS)], epochs.cast("int").alias("__whole"), F.expr("coalesce(share % nullif(tokens, 0), 0L)").alias("__rest"))
    shares = cut(shares)

    # The slot of the order in which each leaf's prefix ends, by two more digits of the order each time: 256 rows a
    # leaf are summed up at once, and the documents of the last slot are one of 16 million parts of the leaf.
    placed = _on_leaves(counted, shares, few).withColumn("__u", _order(seed, F.col("__whole"), F.col("__id")))
    edge = shares.select(*keys, F.lit("").alias("__edge"), F.lit(0).cast("long").alias("__before"))
    for digits in SLOT_DIGITS:
        inside = _on_leaves(placed, edge, few).where(F.col("__u").startswith(F.col("__edge"))).withColumn("__slot", F.substring("__u", 1, digits))
        slots = inside.groupBy(*keys, "__slot", "__rest", "__before").agg(F.sum("__n").alias("__n"))
        slots = slots.withColumn("__end", F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slot")))
        found = slots.where("__end > __rest").groupBy(*keys).agg(F.min_by(F.struct(F.col("__slot"), (F.col("__end") - F.col("__n")).alias("__before")), "__slot").alias("__found"))
        edge = cut(found.select(*keys, F.col("__found.__slot").alias("__edge"), F.col("__found.__before").alias("__before")))
    edge = edge.withColumnRenamed("__edge", "__edge_slot")
    inside = _on_leaves(placed, edge, few).where(F.col("__u").startswith(F.col("__edge_slot")))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__u", "__id")) + F.col("__before")
    last = inside.withColumn("__upto", upto).where("__upto <= __rest").groupBy(*keys).agg(F.max("__u").alias("__last"))
    cuts = shares.join(edge, keys, "left").join(last, keys, "left")
    # Hexadecimal places compare as text; "g" lies beyond them all. Without an edge the prefix is all of the epoch.
    cuts = cut(cuts.select(*keys, "__whole", F.when(F.col("__edge_slot").isNull(), F.lit("g")).otherwise(F.coalesce("__last", "__edge_slot")).alias("__cut"), (F.col("__rest") > 0).alias("__more")))

    chosen = _on_leaves(keyed, cuts, few)
    times = F.col("__whole") + F.when(F.col("__more") & (_order(seed, F.col("__whole"), F.col("__id")) <= F.col("__cut")), 1).otherwise(0)
    chosen = chosen.withColumn("__times", times).where("__times > 0")
    chosen = chosen.select("__row", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("__epoch"))
    return chosen.select("__row.*", F.col("__epoch").alias(epoch)) if epoch else chosen.select("__row.*")

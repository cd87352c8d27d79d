"""Mixing sources to target weights: a token budget goes down a tree of domain, language and source.

Every node shares its budget among its children by weight. What a child cannot use (its capacity is its tokens times
`max_epochs`) goes to its siblings; as a node never gets more than its whole subtree can use, a shortage reaches the
level above only when all siblings are full. Each leaf then takes its documents whole for as many epochs as its budget
covers, and of one further epoch, in an order seeded for that epoch, the longest prefix that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaloom.llm.shared import WORD, lookup, staged, quoted

LEVELS = ("domain", "lang", "source")
SEED, EPOCHS = 42, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def node_name(level: Column) -> Column:
    return F.coalesce(level.cast("string"), F.lit("none"))


def weight_of(level: str, weights: dict[str, int]) -> Column:
    """The whole-number weight of a node by its name; names that are not listed weigh 1."""
    w = F.lit(1)
    for name, value in weights.items():
        w = F.when(F.col(level) == name, value).otherwise(w)
    return w.cast("decimal(38,0)")


def shares(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """`children` (parent, level, capacity, weight and the parent's `budget`) with their own `budget`.

    Children are filled in order of capacity per weight. A child is full if its capacity is at most its part by weight
    of what those before it left; the others share the rest by weight. Whole numbers throughout; what rounding leaves
    over is dealt out by cumulative shares, so that children add up to the parent's budget exactly.
    """
    # capacity / weight is compared exactly as far as a double tells; ties go by name
    order = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).cast("double"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = lambda c: c.cast("decimal(38,0)")
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    sums = children.withColumns({"left": d(left), "weights": d(F.sum("weight").over(after))})
    full = F.col("capacity") * F.col("weights") <= F.col("left") * F.col("weight")
    # once a child is not full, none after it is
    sums = sums.withColumn("full", F.min(full.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    open_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = sums.withColumns({
        "rest": F.max(F.when(~F.col("full"), F.col("left"))).over(open_),
        "open": F.max(F.when(~F.col("full"), F.col("weights"))).over(open_),
        "upto": d(F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))})
    part = F.expr("CAST(rest * upto DIV open AS BIGINT) - CAST(rest * (upto - weight) DIV open AS BIGINT)")
    return (rest.withColumn("budget", F.when(F.col("full"), F.col("capacity").cast("long")).otherwise(part))
            .drop("left", "weights", "full", "rest", "open", "upto", "weight"))


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], total: int | None, percent: int, max_epochs: int) -> DataFrame:
    """Leaves (levels, tokens, n) with their `budget`. The table has one row per leaf: as long as the mixture's recipe."""
    levels = list(LEVELS)
    up = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("decimal(38,0)"))
    below = [up]
    for k in (2, 1, 0):
        below.insert(0, below[0].groupBy(*levels[:k]).agg(F.sum("capacity").cast("decimal(38,0)").alias("capacity")))
    all_tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    goal = int(min(all_tokens * percent // 100 if total is None else total, all_tokens * max_epochs))
    got = below[1].withColumn("budget", F.lit(goal).cast("long"))
    for k in range(1, 4):
        level = levels[k - 1]
        if k > 1:
            got = below[k].join(staged(got).select(*levels[:k - 1], "budget"), levels[:k - 1])
        got = shares(got.withColumn("weight", weight_of(level, weights.get(level, {}))), levels[:k - 1], level)
    return got.drop("capacity")


def end_bins(bins: DataFrame, leaf: list[str]) -> DataFrame:
    """Per leaf the first of its `bins` (bin, in_bin, start: tokens before them) that leads beyond `to`, as `end` (bin, start).

    A leaf comes with 256 bins at most, so the window is small however large the leaf is.
    """
    upto = F.col("start") + F.sum("in_bin").over(Window.partitionBy(*leaf).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return (bins.withColumn("upto", upto).where("upto > to").groupBy(*leaf)
            .agg(F.min(F.struct("bin", (F.col("upto") - F.col("in_bin")).alias("start"))).alias("end")))


def mix_sources(docs: DataFrame, domain: Column, lang: Column, source: Column, tokens: Column,
                weights: dict[str, dict[str, int]], total: int | None = None, percent: int = 100, max_epochs: int = EPOCHS, seed: int = SEED,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, domain, lang, source, n_tokens, budget (the leaf's), copies.

    `copies` says how often the row comes in the mixture, 0 if it does not. Nulls in a level are a node named "none".
    The order of an epoch is md5(seed:epoch:doc_id), ties by text hash; of repeated rows the order is immaterial, and a
    prefix may hold some of them. Documents without tokens cost nothing and come with the prefix they stand in. total:
    the budget in tokens, or if None `percent` of those there are; at most all of them max_epochs times.
    """
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), node_name(domain).alias("domain"),
                              node_name(lang).alias("lang"), node_name(source).alias("source"), tokens.cast("long").alias("n_tokens")))
    leaf = list(LEVELS)
    leaves = staged(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    plan = staged(leaf_budgets(leaves, weights, total, percent, max_epochs).withColumns({
        "epochs": F.expr("CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 0 END"),
        "rest": F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END")}))
    n_rows = rows.count()
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = lookup(rows, plan.drop("tokens"), leaf, "n", n_rows, "inner").withColumn("key", key).withColumn("bin", F.substring("key", 1, 4))
    # where the prefix ends: by two digits of the key, by the next two inside the bin where it ends, then inside that one
    bins = staged(keyed.where("rest > 0").groupBy(*leaf, "bin").agg(F.sum("n_tokens").alias("in_bin"), F.first("rest").alias("to")))
    two = F.substring("bin", 1, 2)
    wide = bins.groupBy(*leaf, two.alias("bin")).agg(F.sum("in_bin").alias("in_bin"), F.first("to").alias("to"))
    first = staged(end_bins(wide.withColumn("start", F.lit(0).cast("long")), leaf))
    narrow = bins.join(first.select(*leaf, F.col("end.bin").alias("in"), F.col("end.start").alias("start")), leaf).where(two == F.col("in"))
    ends = staged(end_bins(narrow, leaf))
    ended = lookup(keyed, ends.join(plan.select(*leaf, "n"), leaf), leaf, "n", n_rows)
    inside = F.col("bin") == F.col("end.bin")
    order = Window.partitionBy(*leaf).orderBy("key", "text_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = (ended.where(inside).withColumn("upto", F.col("end.start") + F.sum("n_tokens").over(order))
            .withColumn("more", (F.col("upto") <= F.col("rest")).cast("int")).drop("upto"))
    others = ended.where(~F.coalesce(inside, F.lit(False))).withColumn(
        "more", F.when(F.col("rest") == 0, 0).otherwise((F.col("bin") < F.col("end.bin")).cast("int")))
    return last.unionByName(others).select("doc_id", "text_hash", *leaf, "n_tokens", "budget",
                                           (F.col("epochs") + F.col("more")).alias("copies"))


def mixed(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text", leaf: dict[str, Column] | None = None) -> DataFrame:
    """`docs` as often as `chosen` (from `mix_sources`) says. `leaf`: the levels that tell rows with equal id and text apart.

    Of repeated rows (equal id, text and `leaf`) the copies are added up and dealt to one of them.
    """
    levels = {} if leaf is None else leaf
    # one struct as key: nulls in it are equal, and the join leaves rows as the window wants them
    key = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("text_hash"), *levels)
    picked = chosen.where("copies > 0").groupBy(key.alias("__key")).agg(F.sum("copies").alias("__copies"))
    mine = docs.withColumn("__key0", F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"),
                                              *(node_name(c).alias(level) for level, c in levels.items())))
    joined = mine.join(picked, F.col("__key0") == F.col("__key"))
    nth = F.row_number().over(Window.partitionBy("__key0").orderBy("__key0"))
    dealt = F.when(nth == 1, F.sequence(F.lit(1).cast("long"), "__copies"))
    return joined.withColumn("__dealt", dealt).withColumn("__i", F.explode("__dealt")).select(*quoted(docs.columns))

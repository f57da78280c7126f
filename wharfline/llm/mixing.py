"""Mixing sources to target weights, by budgets that run down a tree of domains, languages and sources.

`leaf_budgets`: a node's budget is dealt to its children by weight. A child cannot take more than its leaves hold in
MOST_EPOCHS passes; what it leaves goes to its siblings by their weights, again up to what they hold. A node never gets more
than its subtree holds, so a shortage reaches the siblings of the short node first and those of its ancestors only when they are full.

`select_prefix`: a leaf with a budget of e whole epochs and a rest gives all its documents e times, and of epoch e + 1 the prefix
whose tokens fit in the rest, in an order drawn for that leaf, epoch and seed.

Scale: leaves are summed in map tasks; children of a node that hold as much at the same weight are one row when its budget is dealt, and those rows are
first summed in steps of what they hold, so a node with millions of sources is no task's group. A leaf's order is cut into 4096 buckets by the first digits of the draw, so a leaf with a
third of all documents is summed, placed and joined by (leaf, bucket), and only the one bucket in which its prefix ends is
sorted. All arithmetic is in whole numbers, so results do not depend on the order of additions.

Defined results: a null domain, language or source is a group named NONE; a null text has no tokens (it comes with whole epochs, and
with a prefix that reaches its place); weights of 0 give nothing; repeated rows are dealt out like others; an empty table gives an empty
result; extra columns are left alone. Children that are as full are full together; documents of a leaf with the same place in the order (rows that repeat
id and text) are taken in any order, which no count shows; very long texts are documents of many tokens.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.common import written

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
MOST_EPOCHS = 3
SEED = 17
#: Share of the corpus's tokens to select.
SHARE = (1, 2)
#: Target weights by name, for each level; names that are not there weigh 1.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"domain0": 3, "domain1": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {}}
WORD = r"[^\x20\x09-\x0D]+"
BIG = "decimal(38,0)"
#: Steps a doubling in which the level of full children is sought.
STEPS = 16


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    given = weights.get(level) or {}
    known = F.create_map(*[x for name, w in given.items() for x in (F.lit(name), F.lit(w))]) if given else None
    return (F.coalesce(F.try_element_at(known, F.col(level)), F.lit(1)) if known is not None else F.lit(1)).cast(BIG)


def prices(weighted: DataFrame, parents: list[str]) -> DataFrame:
    """(parents.., left, rest_w): of each parent whose budget does not fill all children (parents.., holds, w, given), what is left for those that
    stay short, and their weights. A child that holds h at weight w is full while h / w * (weights from it on) + (what those before it hold) <= given.

    Children with the same h and w are one row, and the level is first sought in steps of h / w; only the rows of the step where it lies are put in order one by one."""
    ratio = F.col("holds").cast("double") / F.col("w").cast("double")
    alike = weighted.where("w > 0").groupBy(*parents, "given", "holds", "w").agg(F.count("*").cast(BIG).alias("n")).withColumn("ratio", ratio)
    alike = written(alike.withColumn("step", F.floor(F.log2(F.col("ratio") + 1) * STEPS)), "alike")
    steps = alike.groupBy(*parents, "given", "step").agg(F.sum(F.col("holds") * F.col("n")).cast(BIG).alias("h"), F.sum(F.col("w") * F.col("n")).cast(BIG).alias("ws"), F.min(F.struct("ratio", "holds", "w")).alias("low"))
    steps = written(steps, "steps")
    within = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    by_step = within.orderBy("step")
    steps = steps.select("*", (F.sum("h").over(by_step) - F.col("h")).cast(BIG).alias("before"), F.sum("ws").over(by_step.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast(BIG).alias("from_w"))
    begins_full = F.col("low.holds") * F.col("from_w") <= F.col("low.w") * (F.col("given").cast(BIG) - F.col("before"))
    # the last step that begins with a full child, and the one after it
    last = F.coalesce(F.max(F.when(begins_full, F.col("step"))).over(within), F.lit(-1))
    after = F.min(F.when(F.col("step") > F.col("last"), F.col("step"))).over(within)
    sought = steps.withColumn("last", last).withColumn("after", after).where("step = last or step = after")
    keys = [*parents, "step"]
    rows = alike.join(sought.select(*keys, "before", "from_w"), keys)
    by_ratio = Window.partitionBy(*keys).orderBy("ratio", "holds", "w").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0))
    placed = rows.select(*keys, "ratio", "holds", "w", (F.col("given").cast(BIG) - F.col("before") - sum_before(F.col("holds") * F.col("n"))).cast(BIG).alias("left"), (F.col("from_w") - sum_before(F.col("w") * F.col("n"))).cast(BIG).alias("rest_w"))
    short = placed.where("holds * rest_w > w * left")
    return short.groupBy(*parents).agg(F.min_by(F.struct(F.greatest("left", F.lit(0).cast(BIG)).alias("left"), "rest_w"), F.struct("ratio", "holds", "w")).alias("p")).select(*parents, F.col("p.left").alias("left"), F.col("p.rest_w").alias("rest_w"))


def deal(children: DataFrame, parents: list[str], level: str, weights: Mapping) -> DataFrame:
    """children (parents.., level, holds, given: the parent's budget) with budget: given is dealt by weight, none above holds."""
    weighted = written(children.withColumn("w", weight_of(level, weights)).withColumn("holds", F.col("holds").cast(BIG)), "children")
    price = written(prices(weighted, parents), "prices")
    # a row for each parent, or one row
    priced = weighted.join(price, parents, "left") if parents else weighted.join(price, F.lit(True), "left")
    share = F.expr("(w * left) div rest_w")
    budget = F.when(F.col("w") == 0, F.lit(0)).when(F.col("rest_w").isNull(), F.col("holds")).otherwise(F.least(share, F.col("holds"))).cast("long")
    return priced.withColumn("budget", budget).withColumn("holds", F.col("holds").cast("long")).drop("w", "left", "rest_w", "given")


def leaf_budgets(leaves: DataFrame, budget: int, weights: Mapping = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget; the argument is the tokens in all."""
    rows = leaves.withColumn("holds", F.col("tokens") * most_epochs)
    given = rows.groupBy("domain").agg(F.sum("holds").alias("holds"), F.lit(budget).cast("long").alias("given"))
    dealt = deal(given, [], "domain", weights)
    for n, level in enumerate(LEVELS[1:], 1):
        above = list(LEVELS[:n])
        below = rows.groupBy(*above, level).agg(F.sum("holds").alias("holds"))
        dealt = deal(below.join(dealt.select(*above, F.col("budget").alias("given")), above), above, level, weights)
    return rows.drop("holds").join(dealt.drop("holds"), list(LEVELS))


def drawn(epoch: Column, seed: int) -> Column:
    """The place of a document in an epoch's order: hexadecimal digits of (seed, epoch, id, text digest)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("digest")))


def select_prefix(docs: DataFrame, budgets: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (id, digest, domain, lang, source, n_tokens) once for each epoch (from 0) that takes them; budgets: of leaves with tokens."""
    keys = list(LEVELS)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    plan = budgets.select(*keys, whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest"))
    placed = docs.join(plan, keys).withColumn("place", drawn(F.col("whole"), seed)).withColumn("bucket", F.substring("place", 1, 3))
    full = placed.where("whole > 0").select("id", *keys, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"))
    open_rows = placed.where("rest > 0")
    sums = open_rows.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("sum"), F.max("rest").alias("limit"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("end", F.sum("sum").over(upto)).select(*keys, "bucket", (F.col("end") - F.col("sum")).alias("start"), "end", "limit").where("start <= limit")
    near = open_rows.join(sums.select(*keys, "bucket", "start", "end"), [*keys, "bucket"])
    inside = near.where("end <= rest")
    order = Window.partitionBy(*keys, "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = near.where("end > rest").withColumn("run", F.col("start") + F.sum("n_tokens").over(order)).where("run <= rest")
    last = [x.select("id", *keys, "n_tokens", F.col("whole").alias("epoch")) for x in (inside, edge)]
    return full.unionByName(last[0]).unionByName(last[1])


def default_domain() -> Column:
    """Documents name no domain; three are made from a digest of the source."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5("source"), 1, 4), 16, 10).cast("int") % 3).cast("string"))


def mix(df: DataFrame, domain: Column | None = None, share: tuple[int, int] = SHARE, weights: Mapping = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, domain, lang, source, n_tokens, epoch): a row for each time that a document is taken."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda c, name: F.coalesce(c, F.lit(NONE)).alias(name)
    docs = written(
        df.select(
            F.col(id_col).alias("id"), F.md5(text).alias("digest"), named(default_domain() if domain is None else domain, "domain"),
            named(F.col("lang"), "lang"), named(F.col("source"), "source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
        ), "mixing")
    leaves = written(docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = written(leaf_budgets(leaves, total * share[0] // share[1], weights, most_epochs), "budgets")
    return select_prefix(docs, budgets, seed).select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "epoch")

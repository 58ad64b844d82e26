"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget flows from the root through domain, language and source. A node that has fewer tokens than its share
(counting every allowed epoch) gives its shortage to its siblings, in proportion to their weights; only what a whole family
cannot take reaches the family's own siblings. Since a node's capacity is the sum over its leaves, filling the
children of each node up to their capacities ("water filling"), level by level from the root, does exactly that.

Each leaf then takes the longest prefix of its documents within its budget, from seeded epochs: epoch e orders the
documents by md5(seed:e:doc_id), and a leaf whose budget exceeds one epoch takes whole epochs first. Running token
sums are taken in two steps, over 4,096 ranges of the order and then inside one range only, so no task holds
a whole leaf; the choice is then a threshold per leaf and epoch that joins to the documents, whose texts never move.

Defined cases: null lang or source form leaves of their own; a null text has no tokens and is taken where the threshold
allows it; rows with equal doc_id tie and are taken or left together (a tie that would exceed the budget is left);
a null doc_id counts as the empty id; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nodetide.llm.common import WORD, cut

_BIG = "decimal(38,0)"
#: Rows of thresholds, one for each leaf and epoch, that a broadcast may hold.
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class MixPlan:
    """Weights are integers; names missing from a table weigh `other`. `percent` of all tokens is the root's budget."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 50, "books": 30, "forum": 20})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 15, "es": 15})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 10
    percent: int = 60
    max_epochs: int = 2
    seed: int = 17
    #: SQL that names a document's domain by its source.
    domain_sql: str = "CASE WHEN source IS NULL THEN 'web' WHEN source RLIKE '^src(1[0-4])$' THEN 'books' WHEN source RLIKE '^src(1[5-9])$' THEN 'forum' ELSE 'web' END"


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast(_BIG)


def fill(children: DataFrame, parents: list[str], name: str, budget: str = "budget") -> DataFrame:
    """Shares the parent's `budget` among children with columns cap and w; replaces budget by the child's.

    Child i is full if cap_i * (weight of all children not fuller than it) + (capacity of fuller ones) * w_i <= budget * w_i,
    where fullness orders by cap / w. What is left is split by weight, rounded down.
    """
    order = W.partitionBy(*parents).orderBy(F.col("ratio"), F.col(name))
    c = children.withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumns({
        "sure": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(_BIG),
        "rest": F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)).cast(_BIG),
    })
    full = F.col("cap") * F.col("rest") <= (F.col(budget) - F.col("sure")) * F.col("w")
    c = c.withColumn("full", full)
    family = W.partitionBy(*parents)
    c = c.withColumns({
        "left": (F.col(budget) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))).cast(_BIG),
        "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(family).cast(_BIG),
    })
    share = F.when(F.col("open") > 0, F.expr("(w * `left`) div `open`").cast(_BIG))
    return c.withColumn(budget, F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), share))).drop("ratio", "sure", "rest", "full", "left", "open")


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """leaves(domain, lang, source, tokens) -> the same with the leaf's budget."""
    leaf = leaves.withColumn("cap", (F.col("tokens") * plan.max_epochs).cast(_BIG))
    total = leaf.select(F.expr(f"(sum(tokens) * {plan.percent}) div 100").cast(_BIG).alias("budget"))
    top = leaf.groupBy("domain").agg(F.sum("cap").cast(_BIG).alias("cap")).withColumn("w", _weight(F.col("domain"), plan.domains, plan.other)).crossJoin(F.broadcast(total))  # one row
    top = fill(top.withColumn("root", F.lit(0)), ["root"], "domain").select("domain", "budget")
    mid = leaf.groupBy("domain", "lang").agg(F.sum("cap").cast(_BIG).alias("cap")).withColumn("w", _weight(F.col("lang"), plan.langs, plan.other)).join(top, "domain")
    mid = fill(mid, ["domain"], "lang").select("domain", "lang", "budget")
    low = leaf.withColumn("w", _weight(F.col("source"), plan.sources, plan.other)).join(mid, ["domain", "lang"])
    return fill(low, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", F.col("budget").cast("long").alias("budget"))


def _keyed(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """doc_id, tokens and the leaf of each document; nulls in the tree get a name."""
    return docs.select(
        "doc_id",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        F.expr(plan.domain_sql).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("(none)")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("(none)")).alias("source"),
    )


def _order_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def thresholds(keyed: DataFrame, plan: MixPlan) -> DataFrame:
    """domain, lang, source, epoch, upto: the largest order key taken. Epochs that take nothing have no row."""
    leaf = ["domain", "lang", "source"]
    budget = leaf_budgets(keyed.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), plan)
    # Epoch e of a leaf has what is left of the budget after e whole epochs, at most its tokens.
    ep = budget.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(plan.max_epochs - 1)))).withColumn("room", F.col("budget") - F.col("epoch") * F.col("tokens")).filter((F.col("room") > 0) | ((F.col("epoch") == 0) & (F.col("tokens") == 0)))
    rows = keyed.join(ep.select(*leaf, "epoch", "room"), leaf).withColumn("key", _order_key(plan.seed)).withColumn("part", F.substring("key", 1, 3))
    sums = rows.groupBy(*leaf, "epoch", "room", "part").agg(F.sum("tokens").alias("t"), F.max("key").alias("last"))
    upto = W.partitionBy(*leaf, "epoch").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("run", F.sum("t").over(upto))
    whole = sums.filter("run <= room").groupBy(*leaf, "epoch").agg(F.max("last").alias("upto"))
    first = sums.filter("run > room").groupBy(*leaf, "epoch").agg(F.min_by(F.struct("part", (F.col("run") - F.col("t")).alias("base")), "part").alias("x")).select(*leaf, "epoch", "x.*")
    inside = rows.join(first, [*leaf, "epoch", "part"]).groupBy(*leaf, "epoch", "part", "base", "room", "key").agg(F.sum("tokens").alias("t"))
    run = F.col("base") + F.sum("t").over(W.partitionBy(*leaf, "epoch", "part").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    partial = inside.withColumn("run", run).filter("run <= room").groupBy(*leaf, "epoch").agg(F.max("key").alias("upto"))
    return whole.unionByName(partial).groupBy(*leaf, "epoch").agg(F.max("upto").alias("upto"))


def _small(t: DataFrame) -> DataFrame:
    """Thresholds, written, with a broadcast hint if they are shown to be few; beyond, the join shuffles and Spark splits a large leaf."""
    t = cut(t, "thresholds")
    return F.broadcast(t) if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t


def mix(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """doc_id, tokens, domain, lang, source and epoch of each document taken, once per epoch that takes it."""
    keyed = cut(_keyed(docs, plan), "mix")
    t = _small(thresholds(keyed, plan))
    return keyed.join(t, ["domain", "lang", "source"]).filter(_order_key(plan.seed) <= F.col("upto")).select("doc_id", "domain", "lang", "source", F.col("epoch").cast("int").alias("epoch"), "tokens")


def mix_documents(docs: DataFrame, plan: MixPlan = MixPlan(max_epochs=1)) -> DataFrame:
    """The rows of `docs` that the plan takes, in their own columns; a row that two epochs take comes twice."""
    keyed = cut(_keyed(docs, plan), "mix")
    t = _small(thresholds(keyed, plan).select(F.struct("domain", "lang", "source").alias("_leaf"), "epoch", "upto"))
    leaf = F.struct(F.expr(plan.domain_sql).alias("domain"), F.coalesce("lang", F.lit("(none)")).alias("lang"), F.coalesce("source", F.lit("(none)")).alias("source"))
    held = docs.select(F.struct(*docs.columns).alias("_d"), "doc_id", leaf.alias("_leaf"))
    taken = held.join(t, "_leaf").filter(_order_key(plan.seed) <= F.col("upto"))
    return taken.select(*[F.col("_d")[c].alias(c) for c in docs.columns])


def _sql_weight(col: str, weights: dict[str, int], other: int) -> str:
    cases = "".join(f" WHEN {col} = '{k}' THEN {v}" for k, v in weights.items())
    return f"CAST(CASE{cases} ELSE {other} END AS HUGEINT)" if cases else f"CAST({other} AS HUGEINT)"


def _sql_fill(name: str, of: str, parents: str, child: str) -> str:
    p = f"PARTITION BY {parents}"
    return f"""
{name}0 AS (SELECT *, cap::DOUBLE / w::DOUBLE AS ratio FROM {of}),
{name}1 AS (SELECT *, coalesce(sum(cap) OVER ({p} ORDER BY ratio, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
 sum(w) OVER ({p} ORDER BY ratio, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}0),
{name}2 AS (SELECT *, cap * rest <= (budget - sure) * w AS is_full FROM {name}1),
{name}3 AS (SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({p}), 0) AS rem, sum(CASE WHEN NOT is_full THEN w END) OVER ({p}) AS unfilled FROM {name}2),
{name} AS (SELECT * EXCLUDE (budget, ratio, sure, rest, is_full, rem, unfilled), CASE WHEN is_full THEN cap ELSE least(cap, (w * rem) // unfilled) END AS budget FROM {name}3)"""


def oracle_sql(plan: MixPlan = MixPlan()) -> str:
    domain = plan.domain_sql.replace("source RLIKE", "source SIMILAR TO").replace("'^", "'").replace("$'", "'")
    return f"""
WITH k AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS HUGEINT) AS tokens, {domain} AS domain,
 coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {plan.max_epochs} AS cap FROM k GROUP BY ALL),
tot AS (SELECT sum(tokens) * {plan.percent} // 100 AS budget FROM leaf),
d_in AS (SELECT 0 AS root, domain, sum(cap) AS cap, {_sql_weight("domain", plan.domains, plan.other)} AS w, any_value(budget) AS budget FROM leaf, tot GROUP BY domain),{_sql_fill("dd", "d_in", "root", "domain")},
l_in AS (SELECT domain, lang, sum(leaf.cap) AS cap, {_sql_weight("lang", plan.langs, plan.other)} AS w, any_value(dd.budget) AS budget FROM leaf JOIN dd USING (domain) GROUP BY domain, lang),{_sql_fill("ll", "l_in", "domain", "lang")},
s_in AS (SELECT domain, lang, source, tokens, leaf.cap, {_sql_weight("source", plan.sources, plan.other)} AS w, ll.budget FROM leaf JOIN ll USING (domain, lang)),{_sql_fill("ss", "s_in", "domain, lang", "source")},
r AS (SELECT k.*, e.epoch, ss.tokens AS leaf_tokens, ss.budget - e.epoch * ss.tokens AS room, md5(concat_ws(':', '{plan.seed}', CAST(e.epoch AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
 FROM k JOIN ss USING (domain, lang, source), (SELECT unnest(range(0, {plan.max_epochs})) AS epoch) e)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(tokens AS BIGINT) AS tokens
FROM (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r)
WHERE run <= room AND (room > 0 OR (epoch = 0 AND leaf_tokens = 0))
"""

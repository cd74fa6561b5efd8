"""Mixing sources to target weights (operator 1): hierarchical budgets, seeded token prefixes.

DataFrame functions only. The tree is domain - language - source. The token budget flows from
the root down: a node shares its budget among its children by their weights, no child above
its capacity (tokens below it times max_epochs). What a child cannot take goes to its siblings
first, by the same weights; because a node's capacity is the sum of its children's, what all
of them cannot take has already gone to the node's own siblings. Shares are whole tokens and
add up.

A leaf fills its budget with epochs, each a seeded order of all its documents: whole epochs,
then the prefix of the next one, whose last document is cut. Only the order near the cut
matters: documents fall into BUCKETS by the leading digits of their seeded hash; buckets before
the one with the cut are taken whole, and only that bucket's rows are sorted. So a leaf with a
third of all rows is neither one group nor one task.

Defined results: null parts of the tree are the node ''; a null or blank text has no tokens and
is never selected; a node without a weight has default_weight; a budget above the capacity is
the capacity. Rows are told apart by all they carry here (id, tokens): repeated rows are equal
in order and may be cut one after the other. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import WS, few_rows, free_name, small_side, stored

MAX_EPOCHS = 2
#: Hash digits (hexadecimal) of a bucket: 4096 buckets a leaf.
BUCKET_DIGITS = 3
LEVELS = ("domain", "lang", "source")
#: Leaves up to this number are sent to all tasks; beyond it they are joined by shuffle.
BROADCAST_LEAVES = 20_000


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def seeded(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def _share(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Budgets of children (key, child, capacity, weight) under parents (key, budget)."""
    group = [F.col(k) for k in key]
    rows = children.join(parents, key) if key else children.crossJoin(parents)  # one parent row: the root
    big = "decimal(38,0)"
    w = Window.partitionBy(*group) if key else Window.partitionBy(F.lit(0))
    # children in the order in which they fill up as the water level rises
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = w.orderBy("ratio", "child")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("ratio", ratio).withColumns(
        {"filled": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "rest_weight": F.sum("weight").over(after)}
    )
    full = (F.col("weight") > 0) & (F.col("capacity").cast(big) * F.col("rest_weight") <= F.col("weight").cast(big) * (F.col("budget") - F.col("filled")))
    rows = rows.withColumn("full", full)
    rows = rows.withColumns({"left": F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(w), "open_weight": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(w)})
    upto = F.coalesce(F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    rows = rows.withColumn("upto", upto)
    part = lambda x: F.when(F.col("open_weight") > 0, F.expr(f"cast(cast(left as decimal(38,0)) * ({x}) div open_weight as bigint)")).otherwise(F.lit(0).cast("long"))
    share = F.when(F.col("full"), F.col("capacity")).otherwise(part("upto") - part("upto - weight"))
    return rows.select(*group, "child", share.cast("long").alias("budget"))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int | Column, default_weight: int = 1, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, budget) of leaves (domain, lang, source, tokens).

    weights: for each level a weight (0 or more) by name. budget: tokens to select in all, or
    an aggregate expression over the leaves.
    """

    def weight(level: str) -> Column:
        table = weights.get(level) or {"": default_weight}
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.coalesce(F.try_element_at(pairs, F.col(level)), F.lit(default_weight)).cast("long")

    have = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("long"))
    total = have.agg(F.least(F.coalesce(F.sum("capacity"), F.lit(0)), F.lit(budget) if isinstance(budget, int) else budget).cast("long").alias("budget"))
    held, key = total, []
    for level in LEVELS:
        children = have.groupBy(*key, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(level)).withColumn("child", F.col(level)).select(*key, "child", "capacity", "weight")
        held = _share(children, held, key).withColumnRenamed("child", level)
        key = [*key, level]
    return have.join(held, list(LEVELS)).select(*LEVELS, "tokens", "budget")


def select_tokens(docs: DataFrame, weights: dict[str, dict[str, int]], budget: int | Column, seed: int, id_col: str = "doc_id", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs (id, domain, lang, source, tokens) with leaf_budget, full_epochs and partial_tokens.

    A document is to be used full_epochs times whole and once, if partial_tokens > 0, by its
    first partial_tokens tokens.
    """
    base = docs.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS], F.col("tokens").cast("long").alias("tokens"))
    base = stored(base, "token-counts")
    leaves = stored(base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    share = stored(budgets(leaves, weights, budget, max_epochs=max_epochs), "budgets")
    few = few_rows(share, BROADCAST_LEAVES)
    small = F.broadcast if few else (lambda d: d)
    plan = share.select(
        *LEVELS,
        F.col("budget").alias("leaf_budget"),
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("full_epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"),
    )
    drawn = base.join(small(plan), list(LEVELS)).withColumn("h", seeded(seed, F.col("full_epochs"), F.col("id"))).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    # tokens of each bucket, and before it in the leaf's order
    per = drawn.where("rest > 0 and tokens > 0").groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = per.withColumn("ahead", F.coalesce(F.sum("t").over(run), F.lit(0))).where("ahead < rest and ahead + t >= rest")
    cut = cut.select(*LEVELS, F.col("bucket").alias("cut_bucket"), "ahead")
    marked = drawn.join(small(cut), list(LEVELS), "left")
    order = Window.partitionBy(*LEVELS).orderBy("h", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    keep = ["id", *LEVELS, "tokens", "leaf_budget", "full_epochs"]
    at = F.col("bucket") == F.col("cut_bucket")
    plain = marked.where(F.col("cut_bucket").isNull() | (F.col("bucket") != F.col("cut_bucket")))
    whole = plain.select(*keep, F.when(F.col("cut_bucket").isNotNull() & (F.col("bucket") < F.col("cut_bucket")), F.col("tokens")).otherwise(0).cast("long").alias("partial_tokens"))
    left = F.col("rest") - F.col("ahead") - F.coalesce(F.sum("tokens").over(order), F.lit(0))
    edge = marked.where(at).withColumn("left", left).select(*keep, F.greatest(F.lit(0), F.least("left", "tokens")).cast("long").alias("partial_tokens"))
    return whole.unionByName(edge).withColumnRenamed("id", id_col)


def prefix(text: Column, n: Column) -> Column:
    """The first n words of a text with the white space before each."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{WS}]*[^{WS}]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix_texts(df: DataFrame, weights: dict[str, dict[str, int]], budget: int | Column, seed: int, domain: Column, text: str = "text", n_chars: str = "n_chars", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixture itself: rows of df as often as their leaf's epochs ask, the last use cut to its token prefix."""
    order = df.columns
    own = {n: free_name(df, n) for n in ("row", "use", "tokens", "full_epochs", "partial_tokens")}
    col = {n: F.col(c) for n, c in own.items()}
    rows = stored(df.withColumn(own["row"], F.monotonically_increasing_id()), "rows")
    counted = rows.select(col["row"].alias("row"), domain.alias("domain"), "lang", "source", n_tokens(F.col(text)).alias("tokens"))
    chosen = select_tokens(counted, weights, budget, seed, "row", max_epochs).where("(full_epochs > 0 or partial_tokens > 0) and tokens > 0")
    drawn = stored(chosen.select(*[F.col(n).alias(own[n]) for n in ("row", "tokens", "full_epochs", "partial_tokens")]), "drawn")
    used = rows.join(small_side(drawn), own["row"])
    uses = used.withColumn(own["use"], F.explode(F.sequence(F.lit(1), (col["full_epochs"] + F.when(col["partial_tokens"] > 0, 1).otherwise(0)).cast("int"))))
    cut = (col["use"] > col["full_epochs"]) & (col["partial_tokens"] < col["tokens"])
    made = uses.withColumn(text, F.when(cut, prefix(F.col(text), col["partial_tokens"])).otherwise(F.col(text)))
    return made.withColumn(n_chars, F.length(text).cast(df.schema[n_chars].dataType)).select(*order) if n_chars in order else made.select(*order)


def oracle(weights: dict[str, dict[str, int]], percent: int, seed: int, domain: str, table: str = "documents", max_epochs: int = MAX_EPOCHS) -> str:
    """DuckDB SQL of the query over select_tokens; domain: an expression over source."""

    def weight(level: str, col: str) -> str:
        return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {"": 1}).items()) + " ELSE 1 END"

    steps, held, key = [], "root", []
    for i, level in enumerate(LEVELS):
        by, group = ", ".join([*key, level]), f"PARTITION BY {', '.join(key)} " if key else ""
        on = " AND ".join(f"c.{k} = h.{k}" for k in key) or "TRUE"
        steps.append(f"""c{i} AS (SELECT {by}, sum(capacity) AS capacity, {weight(level, level)} AS weight FROM leaves GROUP BY {by}),
r{i} AS (SELECT c.*, h.budget, CASE WHEN weight > 0 THEN c.capacity / weight ELSE 'inf'::DOUBLE END AS ratio FROM c{i} c JOIN {held} h ON {on}),
f{i} AS (SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r{i} WINDOW o AS ({group}ORDER BY ratio, {level})),
g{i} AS (SELECT *, weight > 0 AND capacity * rest <= weight * (budget - filled) AS full_ FROM f{i}),
h{i} AS (SELECT *, budget - sum(CASE WHEN full_ THEN capacity ELSE 0 END) OVER w AS left_, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER w AS open_, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM g{i} WINDOW w AS ({group}), o AS ({group}ORDER BY ratio, {level})),
b{i} AS (SELECT {by}, CASE WHEN full_ THEN capacity WHEN open_ > 0 THEN left_ * upto // open_ - left_ * (upto - weight) // open_ ELSE 0 END AS budget FROM h{i})""")
        held, key = f"b{i}", [*key, level]
    cols = ", ".join(LEVELS)
    return rf"""
WITH docs AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS tokens FROM {table}),
leaves AS (SELECT {cols}, sum(tokens) AS tokens, sum(tokens) * {max_epochs} AS capacity FROM docs GROUP BY {cols}),
root AS (SELECT least(sum(capacity), sum(tokens) * {percent} // 100) AS budget FROM leaves),
{", ".join(steps)},
p AS (SELECT d.*, budget AS leaf_budget, CASE WHEN l.tokens > 0 THEN budget // l.tokens ELSE 0 END AS full_epochs, CASE WHEN l.tokens > 0 THEN budget % l.tokens ELSE 0 END AS rest FROM docs d JOIN {held} USING ({cols}) JOIN leaves l USING ({cols})),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {cols} ORDER BY md5('{seed}:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM p)
SELECT doc_id, {cols}, tokens, CAST(leaf_budget AS BIGINT) AS leaf_budget, CAST(full_epochs AS BIGINT) AS full_epochs, CAST(greatest(0, least(tokens, rest - ahead)) AS BIGINT) AS partial_tokens FROM o"""

"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree domain - language - source. A token budget flows down: a node's share is divided
among its children by weight; a child that cannot use its part (its tokens times max_epochs) keeps what it can,
and the rest goes to its siblings by weight, and only when a whole family is full to its ancestors' siblings.
The level at which children fill up is found in closed form from running sums over the siblings ordered by
capacity per weight, as windows over the small table of nodes.

Each leaf then takes a prefix, in tokens, of its seeded epochs: every epoch holds all its documents in an order
drawn by MD5 of (seed, epoch, doc_id). Whole documents are taken while they fit. The prefix sum over a leaf runs
on buckets of the order first, so that no task sorts a whole leaf; only the bucket in which the budget ends is
ordered by rows.

Defined results: null text and texts without words have no tokens and are never selected; a null domain,
language or source is a branch of its own; unknown names have weight 1, a weight of 0 or less gives nothing;
repeated rows count as documents, one after the other in the order; rows with null doc_id have no part in budgets
and are not selected. A bucket in which many rows repeat one doc_id grows with them. Extra columns are kept, but for
earlier columns domain, n_tokens and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import unused, written

LEVELS = ("domain", "lang", "source")
#: A leaf's order is divided into buckets of about so many documents.
BUCKET_DOCS = 2000


def n_tokens(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def default_domain() -> F.Column:
    """A domain for a source name: one of four by the number in it, `other` without a number."""
    number = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), r"(\d{1,9})", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.pmod(number.cast("bigint"), F.lit(4)).cast("string")))


def _weight(column: str, weights: dict[str, float]) -> F.Column:
    known = F.create_map(*[F.lit(x) for pair in (weights or {"": 1.0}).items() for x in pair])
    return F.greatest(F.coalesce(F.element_at(known, F.coalesce(F.col(column), F.lit("\0null"))), F.lit(1.0)).cast("double"), F.lit(0.0))


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent..., name, capacity, weight, budget of the parent) to the budget of each node.

    Children sorted by capacity per weight fill up one after the other: child k is full if its ratio is at most
    (budget - capacity of those before) / (weight of it and those after)."""
    usable = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")))
    open_ = usable.where("weight > 0")
    order = Window.partitionBy(*parent).orderBy("ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = open_.withColumn("level", (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first child that is not full sets the level of all after it.
    water = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", name, "level"))).over(Window.partitionBy(*parent))["level"]
    filled = levels.withColumn("own", F.least(F.col("capacity"), F.coalesce(water, F.lit(float("inf"))) * F.col("weight")))
    return filled.drop("ratio", "level", "budget").withColumnRenamed("own", "budget").unionByName(usable.where("weight <= 0").drop("ratio", "budget").withColumn("budget", F.lit(0.0)))


def leaf_budgets(leaves: DataFrame, total: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """leaves (domain, lang, source, docs, tokens) with `budget`, in tokens, as a whole number."""
    # What no weight reaches is nobody's capacity, so that its share goes to siblings.
    open_ = F.lit(True)
    for name in LEVELS:
        open_ &= _weight(name, weights.get(name, {})) > 0
    usable = leaves.withColumn("tokens", F.when(open_, F.col("tokens")).otherwise(0))
    now, share = None, None
    for depth in range(1, len(LEVELS) + 1):
        path, name = list(LEVELS[:depth]), LEVELS[depth - 1]
        nodes = usable.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("double").alias("capacity")).withColumn("weight", _weight(name, weights.get(name, {})))
        if depth == 1:
            share = nodes.withColumn("root", F.lit(1)).withColumn("budget", F.least(F.lit(float(total)), F.sum("capacity").over(Window.partitionBy("root"))))
            now = _fill(share, ["root"], name).select(*path, "budget")
        else:
            above = now.select(*[F.col(c).alias(f"up_{c}") for c in path[:-1]], "budget")
            match = [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in path[:-1]]
            now = _fill(nodes.join(above, match).drop(*above.columns[:-1]), path[:-1], name).select(*path, "budget")
    up = now.select(*[F.col(c).alias(f"up_{c}") for c in LEVELS], F.floor(F.round("budget", 6)).cast("bigint").alias("budget"))
    return leaves.join(up, [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in LEVELS]).drop(*[f"up_{c}" for c in LEVELS])


def mix(docs: DataFrame, budget_share: float = 0.5, max_epochs: int = 2, seed: str = "mix", weights: dict[str, dict[str, float]] | None = None, domain: F.Column | None = None) -> DataFrame:
    """The selected rows of docs (doc_id, text, lang, source, ...), with domain, n_tokens and copies (how many epochs take the row).

    budget_share: the budget as a share of all tokens; weights: by level (domain, lang, source) and name."""
    domain = default_domain() if domain is None else domain
    ours = {k: unused(docs, k + "_new") for k in ("row", "domain", "n_tokens", "copies")}
    # The rows are numbered once, so that repeats of one doc_id are picked row by row.
    numbered = written(docs.withColumns({ours["row"]: F.monotonically_increasing_id(), ours["domain"]: domain, ours["n_tokens"]: n_tokens()}))
    light = numbered.select(F.col(ours["row"]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col(ours["domain"]).alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(ours["n_tokens"]).alias("tokens")).where("tokens > 0 and doc_id is not null")
    leaves = written(light.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share
    plan = leaf_budgets(leaves, total, max_epochs, weights or {})
    plan = plan.withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens")).withColumn("buckets", F.ceil(F.col("docs") / BUCKET_DOCS))
    plan = written(plan.select(*[F.col(c).alias(f"up_{c}") for c in LEVELS], "passes", "rest", "buckets"))
    match = [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in LEVELS]
    placed = light.join(plan, match).withColumn("ord", F.md5(F.concat_ws("|", F.lit(seed), F.col("passes").cast("string"), F.col("doc_id").cast("string")).cast("binary")))
    placed = placed.withColumn("bucket", F.floor(F.conv(F.substring("ord", 1, 8), 16, 10).cast("bigint") * F.col("buckets") / F.lit(1 << 32))).select("row", "doc_id", *LEVELS, "tokens", "passes", "rest", "ord", "bucket")
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("in_bucket"))
    sums = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("in_bucket"))
    sums = sums.select(*[F.col(c).alias(f"up_{c}") for c in LEVELS], F.col("bucket").alias("up_bucket"), "in_bucket", "before")
    known = written(placed.join(sums, [*match, F.col("bucket") == F.col("up_bucket")]).select(*LEVELS, "row", "doc_id", "tokens", "passes", "rest", "ord", "bucket", "before", "in_bucket"))
    sure = known.where("before >= rest or before + in_bucket <= rest").select("row", (F.col("passes") + F.when(F.col("before") + F.col("in_bucket") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    border = known.where("before < rest and before + in_bucket > rest")
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("ord", "doc_id", "tokens", "row").rowsBetween(Window.unboundedPreceding, 0))
    border = border.withColumn("upto", F.col("before") + running).select("row", (F.col("passes") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    chosen = sure.union(border).where("copies > 0").select(F.col("row").alias(ours["row"]), F.col("copies").cast("bigint").alias(ours["copies"]))
    added = ("domain", "n_tokens", "copies")
    return numbered.join(chosen, ours["row"]).select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *[F.col(ours[c]).alias(c) for c in added])

"""Mixing sources to target weights: hierarchical token budgets and seeded token prefixes.

Weights are whole numbers on the nodes of a domain / language / source tree. A parent's budget is shared among its
children in proportion to their weights; a child cannot take more than the tokens below it times ``max_epochs``, and
what it cannot take goes to its siblings first (water filling). A node passes a shortage to its parent's siblings only
when all its children are full, because its own capacity then is its limit. Each leaf fills its budget in epochs: whole
passes first, then the prefix of the next epoch's seeded order whose documents start before the rest of the budget.

Only DataFrame operations. The tree is a table of (domain, language, source) sums. A leaf's order is cut by its hash
into slices of about ``slice_rows`` documents: sums per slice give each slice's offset, and the running sum stays
within a slice, so a leaf with a third of all rows is spread over many tasks.

Defined cases: a null or empty text has no tokens and is never selected; a null domain, language or source is ``""``;
weights not given are 1, a weight of 0 takes nothing; repeated rows (same id, text and leaf) are selected together, each
as a row; a budget above the whole capacity selects everything ``max_epochs`` times. An empty table gives an empty
result. Other columns are not read, and ``mixed_documents`` returns them untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import kept, unused

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Target weights by name of each level, the budget (a share of all tokens, or a number) and the epochs' seed."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_percent: int = 60
    budget_tokens: int | None = None
    max_epochs: int = 2
    seed: int = 7
    slice_rows: int = 2_000


#: The query's mix: domains 4:3:2:1, languages en 6, de 2, others 1, one source weighted up, one left out.
MIX = Mix({"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2}, "source": {"src1": 3, "src7": 0}})


def domain_of(source: Column) -> Column:
    """A source's domain where the table has none: one of four, by the first hex digit of its md5."""
    return F.concat(F.lit("d"), F.translate(F.substring(F.md5(source), 1, 1), "0123456789abcdef", "0000111122223333"))


def leaf_of(lang_col: str, source_col: str, domain: Column | None) -> dict[str, Column]:
    source = F.coalesce(F.col(source_col), F.lit(""))
    return {"domain": F.coalesce(domain_of(source) if domain is None else domain, F.lit("")),
            "lang": F.coalesce(F.col(lang_col), F.lit("")), "source": source}


def text_identity(text_col: str) -> Column:
    return F.coalesce(F.md5(F.col(text_col)), F.lit(""))


def units(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, domain: Column | None,
          mix: Mix) -> DataFrame:
    """(doc_id, text_key, leaf, tokens, copies): a row for each distinct document of a leaf, written once."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_identity(text_col).alias("text_key"),
        *[v.alias(k) for k, v in leaf_of(lang_col, source_col, domain).items()],
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("one"))
    return kept(rows.groupBy("doc_id", "text_key", *LEVELS, "one").agg(F.count(F.lit(1)).alias("copies"))
                .withColumn("tokens", F.col("one") * F.col("copies")))


def _weight(level: str, mix: Mix) -> Column:
    w = F.lit(1).cast("bigint")
    for name, value in mix.weights.get(level, {}).items():
        w = F.when(F.col(level) == name, F.lit(value).cast("bigint")).otherwise(w)
    return w


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's ``given`` among its children (``cap``, ``weight``): adds ``budget``.

    Children in order of cap / weight fill up one after another as long as the level of the water reaches their cap; the
    others share the rest by weight. Whole-number products, so the result does not depend on the order of sums.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.expr("cast(cap as double) / weight"), name)
    live = nodes.where("weight > 0").withColumns({
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest_weight": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    live = live.withColumn("full", F.expr("cap * rest_weight <= weight * (given - before)"))
    live = live.withColumns({"full_cap": F.sum(F.expr("if(full, cap, 0)")).over(by),
                             "open_weight": F.sum(F.expr("if(full, 0, weight)")).over(by)})
    return live.withColumn("budget", F.expr("if(full, cap, (weight * (given - full_cap)) div open_weight)")).drop(
        "before", "rest_weight", "full", "full_cap", "open_weight")


def leaf_budgets(unit: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, supply, n_docs, budget): one row a leaf."""
    leaves = unit.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))
    live = [F.expr(f"if({lv}_weight > 0, supply, 0)") for lv in LEVELS]
    leaves = leaves.withColumns({f"{lv}_weight": _weight(lv, mix) for lv in LEVELS})
    leaves = leaves.withColumn("cap", F.least(*live) * mix.max_epochs)
    # the budget: a share of all tokens, summed over the domains
    budget = F.lit(mix.budget_tokens) if mix.budget_tokens is not None else F.expr(
        f"(sum(supply) over (partition by 0) * {int(mix.budget_percent)}) div 100")
    given = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"{level}_weight").alias("weight"),
                                          F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("given", budget.cast("bigint")) if given is None else nodes.join(given, path[:-1])
        given = fill(nodes, path[:-1], level).select(*path, F.col("budget").alias("given"))
    return leaves.select(*LEVELS, "supply", "n_docs").join(given.withColumnRenamed("given", "budget"), list(LEVELS))


def selected(unit: DataFrame, mix: Mix) -> DataFrame:
    """(doc_id, text_key, leaf, one, copies, budget, epoch): the documents of each epoch that a leaf's budget reaches."""
    plan = leaf_budgets(unit, mix).where("supply > 0").withColumns({
        "whole": F.expr("budget div supply"), "rest": F.expr("budget % supply"),
        "slices": F.expr(f"1 + n_docs div {int(mix.slice_rows)}")})
    plan = kept(plan)  # a table of its own, so that the join can be a broadcast or split a frequent leaf
    rows = unit.where("one > 0").join(plan, list(LEVELS))
    draw = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"),
                             F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key"))
    rows = rows.withColumn("draw", draw).withColumn(
        "slice", F.expr("(cast(conv(substring(draw, 1, 8), 16, 10) as bigint) * slices) div 4294967296"))
    # dealt by slice before the window, which the leaf's own partitioning would satisfy too
    rows = rows.repartition(*LEVELS, "slice")
    sums = rows.groupBy(*LEVELS, "slice").agg(F.sum("tokens").alias("slice_tokens"))
    ahead = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEVELS, "slice", F.coalesce(F.sum("slice_tokens").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*LEVELS, "slice").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, [*LEVELS, "slice"]).withColumn(
        "start", F.col("offset") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    times = F.col("whole") + F.expr("if(start < rest, 1, 0)")
    return rows.where(times > 0).select("doc_id", "text_key", *LEVELS, "one", "copies", "budget", F.explode(
        F.sequence(F.lit(0), (times - 1).cast("int"))).alias("epoch"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source", domain: Column | None = None, mix: Mix = MIX) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch, leaf_budget): one row for each time a document is taken."""
    picked = selected(units(docs, id_col, text_col, lang_col, source_col, domain, mix), mix)
    return picked.select("doc_id", *LEVELS, F.col("one").alias("n_tokens"), F.col("epoch").cast("bigint").alias("epoch"),
                         F.col("budget").alias("leaf_budget"),
                         F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    source_col: str = "source", domain: Column | None = None, mix: Mix = MIX) -> DataFrame:
    """The taken documents with all their columns, a row for each time one is taken."""
    picked = selected(units(docs, id_col, text_col, lang_col, source_col, domain, mix), mix)
    parts = {"id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "key": text_identity(text_col),
             **leaf_of(lang_col, source_col, domain)}
    *keys, n_times, epoch = unused(docs, *[f"__{k}" for k in parts], "__times", "__epoch")
    times = picked.groupBy("doc_id", "text_key", *LEVELS).agg(F.count(F.lit(1)).alias(n_times))
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key"), *[F.col(level) for level in LEVELS]]
    times = times.select(*[c.alias(k) for c, k in zip(own, keys)], n_times)
    rows = docs.select("*", *[v.alias(k) for k, v in zip(keys, parts.values())]).join(times, keys)
    if mix.max_epochs > 1:
        rows = rows.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(n_times).cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])

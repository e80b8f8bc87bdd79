"""Context packets: an ordered first-fit choice under a budget, and what a packet reports.

First fit is a fold in rank order: a candidate that no longer fits is left out and the next
one is tried. It runs in rounds. A round takes, of each group, all candidates in order up to
the first one that overflows the budget, by a running sum; that one is left out, and so is all
that is larger than the room that remains. The number of rounds depends on how often a budget
is overflowed, not on the number of candidates. Running sums are taken in stretches of about
``CHUNK`` candidates behind the sum of the stretches before them, so a group is never in one
task as a whole, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, tokens
from ..functions.text import round_half_up

CHUNK = 10_000  # candidates of a group in a stretch


def first_fit(candidates: DataFrame, budgets: DataFrame, group: str, checkpoint) -> DataFrame:
    """Chosen candidates (group, id, ord, cost, used_after).

    ``candidates``: group, id, ord (the order of choice, unique in a group), cost. ``budgets``:
    group, used, cap. ``checkpoint`` writes a small table and gives it back.
    """
    rows = checkpoint(candidates.select(F.col(group).alias("g"), F.col("id").cast("string").alias("id"), F.col("ord").cast("long").alias("ord"), F.col("cost").cast("long").alias("cost")))
    extent = rows.groupBy("g").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.ceil(F.count("*") / CHUNK).alias("stretches"))
    state = checkpoint(budgets.select(F.col(group).alias("g"), F.col("used").cast("long").alias("used"), F.col("cap").cast("long").alias("cap")).join(extent, "g").withColumn("at", F.col("lo") - 1))
    chosen = None
    while True:
        open_ = rows.join(state, "g").filter((F.col("ord") > F.col("at")) & (F.col("used") + F.col("cost") <= F.col("cap")))
        open_ = open_.withColumn("stretch", F.floor((F.col("ord") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo") + 1) * F.col("stretches")))
        sums = open_.groupBy("g", "stretch").agg(F.sum("cost").alias("cost"), F.max("used").alias("used"), F.max("cap").alias("cap"))
        base = F.coalesce(F.sum("cost").over(Window.partitionBy("g").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # Stretches behind the first overflow wait for the next round.
        near = open_.join(sums.withColumn("base", base).filter(F.col("used") + F.col("base") <= F.col("cap")).select("g", "stretch", "base"), ["g", "stretch"])
        after = F.col("used") + F.col("base") + F.sum("cost").over(Window.partitionBy("g", "stretch").orderBy("ord"))
        met = checkpoint(near.withColumn("used_after", after).select("g", "ord", "id", "cost", "used_after", (F.col("used_after") <= F.col("cap")).alias("fits"), "hi"))
        if met.isEmpty():
            break
        new = met.filter("fits").select("g", "ord", "id", "cost", "used_after")
        chosen = new if chosen is None else chosen.unionByName(new)
        over = met.groupBy("g").agg(F.max(F.when(F.col("fits"), F.col("used_after"))).alias("now"), F.min(F.when(~F.col("fits"), F.col("ord"))).alias("next"))
        moved = state.join(over, "g").filter("next is not null")
        state = checkpoint(moved.select("g", F.coalesce("now", "used").alias("used"), "cap", "lo", "hi", "stretches", F.col("next").alias("at")))
        if state.isEmpty():
            break
    if chosen is None:
        chosen = rows.select("g", "ord", "id", "cost", F.col("cost").alias("used_after")).limit(0)
    return chosen.withColumnRenamed("g", group)


def includes_source(is_target: Column, escalates: Column, mode: Column, risk: Column) -> Column:
    """Whether a symbol comes with its source."""
    return is_target | escalates | ((mode == "safe") & (risk >= 2))


def candidate_cost(contract_tokens: Column, body_tokens: Column, with_source: Column) -> Column:
    return contract_tokens + F.when(with_source, body_tokens).otherwise(0)


def created_quality(has_target: Column, has_contracts: Column, has_tests: Column, removed: Column, total: Column) -> Column:
    """Estimated quality of a new packet."""
    one = lambda c, x: F.when(c, x).otherwise(0.0)
    base = F.lit(0.5) + one(has_target, 0.15) + one(has_contracts, 0.2) + one(has_tests, 0.15)
    return round_half_up(F.when(removed < total * 0.3, F.least(F.lit(1.0), base + 0.1)).otherwise(base))


def expanded_quality(has_target: Column, has_contracts: Column, has_evidence: Column, omitted: Column) -> Column:
    """Estimated quality of an expanded packet."""
    one = lambda c, x: F.when(c, x).otherwise(0.0)
    base = F.lit(0.5) + one(has_target, 0.25) + one(has_contracts, 0.15) + one(has_evidence, 0.10)
    return round_half_up(F.when(omitted == 0, F.least(F.lit(1.0), base + 0.05)).otherwise(base))


def created_risk(satisfied: Column, has_target: Column, removed_bodies: Column, contracts: Column) -> Column:
    return F.when(~satisfied, "high").when((removed_bodies > 0) & ~has_target, "high").when(removed_bodies > contracts * 0.3, "medium").otherwise("low")


def expanded_risk(has_target: Column, removed_bodies: Column, contracts: Column) -> Column:
    return F.when(~has_target, "high").when(removed_bodies > contracts * 0.3, "medium").otherwise("low")


def recovery_hints(sources: Column, contracts: Column, has_tests: Column, task_type: Column, omitted: Column) -> Column:
    """What would make a packet better, in order."""
    return F.array_compact(
        F.array(
            F.when(sources == 0, "add_target_source"), F.when(contracts == 0, "add_contracts"), F.when(~has_tests & (task_type == "bugfix"), "add_tests"), F.when(omitted > sources * 2, "reduce_omissions"),
        )
    )


def recovery_reason(quality: Column) -> Column:
    return F.when(quality < 0.85, "missing_critical_sources").otherwise("quality_below_floor")


def build(candidates: DataFrame, tasks: DataFrame, checkpoint) -> dict[str, DataFrame]:
    """Packets of the candidates of each context.

    ``candidates``: context_id, id, ord, contract_tokens, body_tokens, escalates, risk, is_target.
    ``tasks``: context_id, budget, mode, quality_floor, task_type, project_tokens, evidence_tokens, has_tests.
    Gives ``selected``, ``omitted`` and ``packets``. The target is always in, at no more than the share for sources.
    """
    shares = tokens.packet_shares(F.col("budget"), F.col("mode"))
    t = tasks.withColumn("sources_share", shares["sources"])
    c = candidates.join(tasks.select("context_id", "mode"), "context_id")
    c = c.withColumn("with_source", includes_source(F.col("is_target"), F.col("escalates"), F.col("mode"), F.col("risk")))
    c = c.withColumn("cost", candidate_cost(F.col("contract_tokens"), F.col("body_tokens"), F.col("with_source")))
    target = c.filter("is_target").join(t.select("context_id", "sources_share"), "context_id")
    target = target.groupBy("context_id").agg(F.min_by(F.struct(F.col("id").cast("string").alias("id"), "ord", F.least("body_tokens", "sources_share").alias("cost"), "body_tokens"), "ord").alias("t"))
    target = checkpoint(target.select("context_id", "t.*"))
    budgets = t.join(target.select("context_id", F.col("cost").alias("target_cost")), "context_id", "left")
    budgets = budgets.select("context_id", (F.col("project_tokens") + F.coalesce("target_cost", F.lit(0))).cast("long").alias("used"), F.col("budget").cast("long").alias("cap"))
    own = target.select("context_id", F.col("id").alias("own_id"))
    rest = c.join(own, "context_id", "left").filter("own_id is null or cast(id as string) <> own_id")
    picked = first_fit(rest, budgets, "context_id", checkpoint)
    chosen = picked.select("context_id", "id", "cost").unionByName(target.select("context_id", "id", "cost"))
    chosen = checkpoint(chosen)
    detail = c.withColumn("id", F.col("id").cast("string"))
    # A rank or a name may be hot, but (context, id) is unique: the join spreads.
    selected = detail.drop("cost").join(chosen, ["context_id", "id"])
    omitted = detail.join(chosen.select("context_id", "id"), ["context_id", "id"], "left_anti").select("context_id", "id", F.lit("token_budget").alias("reason"), F.col("cost").alias("estimated_tokens"))
    sums = selected.groupBy("context_id").agg(
        F.sum("cost").alias("spent"), F.count("*").alias("contracts"), F.count_if(F.col("with_source") & (F.col("body_tokens") > 0)).alias("sources"), F.max(F.col("is_target") & F.col("with_source")).alias("has_target")
    )
    totals = candidates.groupBy("context_id").agg(F.count("*").alias("total"))
    p = t.join(totals, "context_id", "left").join(sums, "context_id", "left").na.fill(0, ["total", "spent", "contracts", "sources"])
    p = p.withColumns({"has_target": F.coalesce("has_target", F.lit(False)), "removed": F.col("total") - F.col("contracts"), "tokens": F.col("project_tokens") + F.col("spent") + F.col("evidence_tokens")})
    p = p.withColumn("quality", created_quality(F.col("has_target"), F.col("contracts") > 0, F.col("has_tests"), F.col("removed"), F.col("total")))
    p = p.withColumn("satisfied", F.col("quality") >= F.col("quality_floor"))
    p = p.withColumn("risk", created_risk(F.col("satisfied"), F.col("has_target"), F.lit(0), F.col("total")))
    hints = recovery_hints(F.col("sources"), F.col("contracts"), F.col("has_tests"), F.col("task_type"), F.col("removed"))
    p = p.withColumn("hints", F.when(~F.col("satisfied"), hints)).withColumn("reason", F.when(~F.col("satisfied"), recovery_reason(F.col("quality"))))
    return {"selected": selected, "omitted": omitted, "packets": p.drop("sources_share")}


def better_of(first: DataFrame, retry: DataFrame) -> DataFrame:
    """One packet a context: the retry with half as much budget again if it is satisfied and better, where the first was not satisfied and had hints."""
    b = retry.select(*[F.col(c).alias(c if c == "context_id" else f"r_{c}") for c in retry.columns])
    out = first.join(b, "context_id", "left")
    tried = ~F.col("satisfied") & (F.size(F.coalesce("hints", F.array().cast("array<string>"))) > 0)
    take = F.coalesce(tried & F.col("r_satisfied") & (F.col("r_quality") > F.col("quality")), F.lit(False))
    cols = [F.when(take, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in first.columns if c != "context_id"]
    return out.select("context_id", *cols, tried.alias("attempted"), take.alias("succeeded"), F.col("quality").alias("quality_before"))


def enriched(packets: DataFrame, callers: DataFrame, tests: DataFrame) -> DataFrame:
    """Packets with the numbers of callers and related tests of their target (target_id)."""
    n = lambda d, name: d.groupBy("target_id").agg(F.count("*").alias(name))
    return packets.join(n(callers, "callers"), "target_id", "left").join(n(tests, "related_tests"), "target_id", "left").na.fill(0, ["callers", "related_tests"])


def evidence_layer(tasks: DataFrame) -> DataFrame:
    """Evidence of a task (tests, stack_trace, diagnostics) as rows."""
    kinds = [F.struct(F.lit(k).alias("ord"), F.lit(name).alias("type"), F.col(c).alias("data")) for k, (name, c) in enumerate((("tests", "tests"), ("stackTrace", "stack_trace"), ("diagnostics", "diagnostics")))]
    return tasks.select("context_id", F.inline(F.array(*kinds))).filter("coalesce(data, '') <> ''")


def coverage(sources: DataFrame, contracts: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a packet covers, hashed: sources (source), contracts (contract, canonical JSON) and evidence (data)."""
    cols = ["context_id", "kind", "file_path", "symbol_id", "revision", "content_hash", "token_count"]

    def rows(df: DataFrame, kind: Column, content: Column, estimate: str) -> DataFrame:
        return df.withColumns({"kind": kind, "content_hash": identity.content_hash(content), "token_count": tokens.packet_tokens(content, estimate)}).select(*[c for c in cols if c in (*df.columns, "kind", "content_hash", "token_count")])

    out = rows(sources, F.lit("exact_source"), F.coalesce("source", F.lit("")), "code")
    out = out.unionByName(rows(contracts, F.lit("contract"), F.col("contract"), "json"), allowMissingColumns=True)
    ev = rows(evidence, F.when(F.col("type") == "tests", "test").otherwise("diagnostic"), F.col("data"), "diagnostic")
    return out.unionByName(ev, allowMissingColumns=True)


def not_covered(claims: DataFrame, covered: DataFrame) -> DataFrame:
    """Claims whose content no packet has covered yet."""
    return claims.join(covered.select("content_hash").distinct(), "content_hash", "left_anti")


def overlay(present: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows of a packet and the requested ones that it lacks (context_id, id)."""
    new = requested.join(present, ["context_id", "id"], "left_anti").dropDuplicates(["context_id", "id"])
    return present.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))


def restored(removed: DataFrame, loaded: DataFrame) -> DataFrame:
    """Removed ids that are still missing after some were loaded."""
    return removed.join(loaded, ["context_id", "id"], "left_anti")

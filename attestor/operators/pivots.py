"""Follow-ups that lead to further follow-ups, within a fan-out, a depth and a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.urls import private_ipv4
from attestor.operators import discovery
from attestor.sources.steps import cut, passing

#: What may be followed, and how many of a level are: with one level left, with two, with more.
PIVOTABLE = ("IP", "DOMAIN", "SUBDOMAIN")
SURE = ("CONFIRMED", "HIGH")
FAN_OUT = (5, 3, 2)
BUDGET, MOST_DEPTH = 8, 3
SEARCH_BUDGET, SEARCH_DEPTH, SEARCH_FOLLOWED = 25, 2, 4


def auto_pivots(cases: DataFrame, found: DataFrame, answers: DataFrame, depth: int = MOST_DEPTH, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Depth first through what collections turn up, for all cases at once: (follow-ups, entities).

    cases(case, target), found(case, ord, kind, value, confidence): what the first
    collection gave; answers(on_kind, on, ord, kind, value, confidence): what a
    collection of an entity gives, with a null value where it gives nothing.

    A level takes the first entities, in the order in which the case came to know
    them, that may be followed and weren't: as many as the fan-out says and the
    budget allows. Each is collected, what is new goes to the end of the case's
    entities, and a level with one step less begins. What a level has taken it
    follows, also if a deeper one has meanwhile. An entity is what it was when it was first seen.
    Entities without answers can't be collected and cost nothing.

    A round makes one step of every case that isn't done, so there are as many rounds
    as the longest case has steps, which the budget bounds. A case's state is one
    row: its open levels, and the first ``budget`` + 5 entities that may be followed,
    as more can't matter. All it knows is a table, against which a step's answers are
    compared by a join.

    Equal ``ord`` go by kind and value; a null target, value or case is nothing.
    """
    with passing(cases.sparkSession) as kept:
        key = ["kind", "value"]
        first_seen = lambda df, by: df.groupBy(*by, *key).agg(F.min("ord").alias("ord"), F.min_by("confidence", F.struct("ord", "confidence")).alias("confidence"))
        has_answer = cut(answers.where("on IS NOT NULL").select(F.col("on_kind").alias("kind"), F.col("on").alias("value")).distinct(), "answered")
        given = cut(first_seen(answers.where("on IS NOT NULL AND value IS NOT NULL"), ["on_kind", "on"]), "answers")
        private = (F.col("kind") == "IP") & private_ipv4(F.col("value"))
        may = F.col("kind").isin(*PIVOTABLE) & F.col("confidence").isin(*SURE) & ~F.coalesce(private, F.lit(False))
        room = budget + max(FAN_OUT)

        def ready(df: DataFrame) -> DataFrame:
            """case, more: the first entities that may be followed, of each case."""
            fit = df.where(may).join(has_answer, key, "left_semi")
            few = fit.withColumn("k", F.row_number().over(Window.partitionBy("case").orderBy("ord", *key))).where(F.col("k") <= room)
            return few.groupBy("case").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", *key))), lambda x: F.struct(*(x[c] for c in key))).alias("more"))

        kind = "array<struct<kind:string,value:string>>"
        known = cut(first_seen(found.where("case IS NOT NULL AND value IS NOT NULL"), ["case"]).withColumn("step", F.lit(0)), "known")
        ids = cases.where("case IS NOT NULL").groupBy("case").agg(F.min("target").alias("target"))
        start = ids.join(ready(known), "case", "left").select("case", F.lit(0).alias("step"), F.lit(budget).alias("left"), F.coalesce("more", F.array().cast(kind)).alias("ready"), F.array_compact(F.array("target")).alias("visited"))
        start = start.withColumn("levels", F.array(level(F.lit(depth), F.lit(""), F.col("ready"), F.col("visited"), F.col("left"))))
        state, steps = still_open(cut(start, "state")), []
        while not state.isEmpty():
            top = F.try_element_at("levels", F.lit(-1))
            path = F.when(top["path"] == "", (F.col("step") + 1).cast("string")).otherwise(F.concat(top["path"], F.lit("."), (F.col("step") + 1).cast("string")))
            moved = state.select("case", (F.col("step") + 1).alias("step"), (F.col("left") - 1).alias("left"), "ready", "visited", "levels", top["depth"].alias("depth"), path.alias("path"), F.get(top["queue"], F.lit(0)).alias("at"))
            rest = lambda x: F.struct(x["depth"].alias("depth"), x["path"].alias("path"), F.slice(x["queue"], F.lit(2), F.greatest(F.size(x["queue"]) - 1, F.lit(0))).alias("queue"))
            moved = moved.withColumn("levels", F.concat(F.slice("levels", F.lit(1), F.greatest(F.size("levels") - 1, F.lit(0))), F.array(rest(F.try_element_at("levels", F.lit(-1))))))
            moved = moved.withColumn("visited", F.array_union("visited", F.array("at.value")))
            asked = moved.select("case", F.col("at.kind").alias("on_kind"), F.col("at.value").alias("on"), "step")
            new = cut(asked.join(given, ["on_kind", "on"]).select("case", *key, "ord", "confidence", "step").join(known.select("case", *key), ["case", *key], "left_anti"), "new")
            known = known.unionByName(new)
            came = new.groupBy("case").agg(F.count("*").alias("new"))
            moved = moved.join(ready(new), "case", "left").join(came, "case", "left")
            moved = moved.withColumn("ready", F.slice(F.concat("ready", F.coalesce("more", F.array().cast(kind))), 1, room)).withColumn("new", F.coalesce("new", F.lit(0).cast("long")))
            deeper = level(F.col("depth") - 1, F.col("path"), F.col("ready"), F.col("visited"), F.col("left"))
            moved = cut(moved.withColumn("levels", F.concat("levels", F.when(F.col("depth") > 1, F.array(deeper)).otherwise(F.array().cast("array<struct<depth:int,path:string,queue:" + kind + ">>")))), "moved")
            steps.append(moved.select("case", "step", "depth", "path", F.col("at.kind").alias("kind"), F.col("at.value").alias("target"), "new", "left"))
            state = still_open(moved.select("case", "step", "left", "ready", "visited", "levels"))
        none = cases.sparkSession.createDataFrame([], f"case {dict(cases.dtypes)['case']}, step int, depth int, path string, kind string, target string, new long, left int")
        for s in steps:
            none = none.unionByName(s)
        return kept(none), kept(known.select("case", *key, "confidence", "step", "ord"))


def level(depth: Column, path: Column, ready: Column, visited: Column, left: Column) -> Column:
    """A level and what it takes: the first that weren't visited, by the fan-out of its depth and at most the budget that is left."""
    fan = F.when(depth == 1, FAN_OUT[0]).when(depth == 2, FAN_OUT[1]).otherwise(FAN_OUT[2])
    fresh = F.filter(ready, lambda x: ~F.array_contains(visited, x["value"]))
    return F.struct(depth.cast("int").alias("depth"), path.alias("path"), F.slice(fresh, F.lit(1), F.greatest(F.least(fan, left), F.lit(0))).alias("queue"))


def still_open(state: DataFrame) -> DataFrame:
    """Cases that have a budget and something to follow; levels that are done go."""
    return state.withColumn("levels", F.filter("levels", lambda x: F.size(x["queue"]) > 0)).where((F.col("left") > 0) & (F.size("levels") > 0))


def search_loop(indicators: DataFrame, leads: DataFrame, known_urls: DataFrame, landed: DataFrame, budget: int = SEARCH_BUDGET, depth: int = SEARCH_DEPTH, followed: int = SEARCH_FOLLOWED) -> DataFrame:
    """Pivots of a search and of the searches that they start -> case, depth, kind, norm, ord, action, accepted, reason.

    indicators(case, kind, value, rule, source, ord), leads(case, kind, norm), known_urls(case, url);
    landed(on_kind, on, kind, value, rule, source, ord): the indicators in what a search for a pivot's norm returned.

    At each depth all indicators so far are judged anew and proposed, under what is left of the case's budget; what
    was accepted before is a duplicate. The first ``followed`` accepted handles, hosts and addresses are searched
    for, and what comes of that is added after all that was there. Depth is a parameter of the feature, not a bound of the work.
    """
    with passing(indicators.sparkSession) as kept:
        columns = ["case", "kind", "value", "rule", "source", "ord"]
        seen = indicators.select(*columns, F.lit(0).alias("round"))
        taken = leads.select("case", "kind", "norm").distinct()
        spent, rows = None, []
        for d in range(1, max(1, depth) + 1):
            place = F.struct(F.col("round").alias("r"), F.col("ord").alias("o"))
            judged = cut(discovery.annotate(seen.withColumn("ord", place), leads, known_urls, by=("case",)), "judged")
            proposed = cut(discovery.propose_pivots(judged, "case", budget, known=taken, spent=spent).withColumn("depth", F.lit(d)), "proposed")
            rows.append(proposed)
            accepted = proposed.where("accepted")
            if d == depth or accepted.isEmpty():
                break
            rank = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("priority"), "kind", "ord"))
            able = accepted.where(F.col("kind").isin("username", "domain", "email"))
            asked = able.withColumn("k", rank).where(F.col("k") <= followed).select("case", F.col("kind").alias("on_kind"), F.col("norm").alias("on"))
            more = asked.join(landed, ["on_kind", "on"]).select(*columns, F.lit(d).alias("round"))
            seen = cut(seen.unionByName(more), "seen")
            taken = taken.unionByName(accepted.select("case", "kind", "norm"))
            used = accepted.groupBy("case").agg(F.count("*").alias("spent"))
            spent = used if spent is None else spent.unionByName(used).groupBy("case").agg(F.sum("spent").alias("spent"))
            spent = cut(spent, "spent")
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return kept(out.select("case", "depth", "kind", "norm", F.col("ord.r").alias("round"), F.col("ord.o").alias("ord"), "action", "accepted", "reason"))

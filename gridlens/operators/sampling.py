"""Deterministic sampling and assignment by hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens import protocol as P
from gridlens.functions.keys import hash_key, hash_parity
from gridlens.operators.distributed import materialize, running


def exactly(rows: DataFrame, n: int, what: str) -> DataFrame:
    """The rows, stored, if there are n of them; a pool that is too small is an error and not a shorter sample."""
    kept = materialize(rows)
    found = kept.count()
    if found < n:
        raise ValueError(f"need {n} {what}, found {found}")
    return kept


def hash_sample(pool: DataFrame, n: int, seed: str, label: str, item: str) -> DataFrame:
    """The n items with the smallest hashes."""
    return exactly(pool.orderBy(hash_key(seed, "sample", label, F.col(item)), item).limit(n), n, f"{label} cases")


def one_per_question(candidates: DataFrame, n: int, version: str, salt: str) -> DataFrame:
    """One candidate from each of n questions: questions and candidates both in hash order.

    ``place`` counts the questions in that order.
    """
    ranked = candidates.withColumn("_hash", hash_key(version, F.col("pair_id"), salt))
    chosen = ranked.groupBy("question_id").agg(F.min(F.struct("_hash", "pair_id")).alias("pick"))
    order = hash_key(version, F.col("question_id"), salt, "question")
    kept = chosen.select("question_id", F.col("pick.pair_id").alias("pair_id"), order.alias("_order"))
    first = kept.orderBy("_order", "question_id").limit(n)
    # n rows at most: the window without keys runs over the sample, not over the pool.
    place = F.row_number().over(Window.orderBy("_order", "question_id"))
    return exactly(first.select("question_id", "pair_id", place.alias("place")), n, f"questions for {salt}")


def assign_sides(items: DataFrame, stratum: str, order: Column) -> DataFrame:
    """First half of each stratum in hash order gets side A, the rest B.

    Strata are few and large, so positions come from the sliced running count rather than a window per stratum.
    """
    keyed = items.withColumn("_order", order)
    placed = running(keyed, ["_order"], {"_position": ("sum", F.lit(1).cast("bigint"))}, keys=[stratum])
    sizes = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    return (
        placed.join(sizes, stratum)
        .withColumn("side", F.when(F.col("_position") <= F.floor(F.col("_size") / 2), "A").otherwise("B"))
        .drop("_order", "_position", "_size")
    )


def proportional_quota(counts: DataFrame, n: int | Column, key: str, tie: Column, *, capacity: str | None = None,
                       spare_tie: Column | None = None) -> DataFrame:
    """Largest-remainder allocation of n draws to groups in proportion to their counts.

    ``counts`` is an aggregate with one row per pattern.  Where ``capacity`` names a column, no group gets more than
    that; what is cut goes, draw by draw, to the group with most room left (ties by ``spare_tie``).  Giving draws to
    the roomiest group lowers the rooms from the top like water: the level is found among the sorted rooms, so no
    draw is dealt singly.  More draws than all groups hold are an error.
    """
    whole = Window.partitionBy(F.lit(True))
    draws = n if isinstance(n, Column) else F.lit(n)
    exact = draws.cast("double") * F.col("count") / F.sum("count").over(whole)
    based = counts.withColumn("_exact", exact).withColumn("_base", F.floor("_exact")).withColumn("_n", draws.cast("bigint"))
    order = whole.orderBy((F.col("_exact") - F.col("_base")).desc(), F.col("count").desc(), tie, F.col(key))
    ranked = based.withColumn("_rank", F.row_number().over(order)).withColumn(
        "_left", F.col("_n") - F.sum("_base").over(whole))
    wanted = (F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("bigint")
    room = F.col(capacity if capacity else "count")
    kept = ranked.withColumn("_given", F.least(wanted, room)).withColumn("_room", room - F.col("_given"))
    kept = kept.withColumn("_excess", F.sum(wanted - F.col("_given")).over(whole))
    falling = whole.orderBy(F.col("_room").desc(), F.col(key))
    kept = kept.withColumn("_place", F.row_number().over(falling)).withColumn(
        "_above", F.sum("_room").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Groups down to this place are lowered when their rooms above the group's own sum up to no more than the excess.
    lowered = F.col("_above") - F.col("_place") * F.col("_room") <= F.col("_excess")
    level = F.when(lowered, F.struct("_place", F.greatest(
        F.lit(0), F.ceil((F.col("_above") - F.col("_excess")) / F.col("_place"))).alias("level")))
    kept = kept.withColumn("_level", F.max(level).over(whole)["level"])
    kept = kept.withColumn("_taken", F.greatest(F.lit(0), F.col("_room") - F.col("_level")))
    kept = kept.withColumn("_rest", F.col("_excess") - F.sum("_taken").over(whole))
    full = kept.withColumn("_open", (F.col("_room") >= F.col("_level")) & (F.col("_level") > 0))
    turn = F.row_number().over(whole.orderBy(F.col("_open").desc(), tie if spare_tie is None else spare_tie, F.col(key)))
    one = F.when(F.col("_open") & (turn <= F.col("_rest")), 1).otherwise(0)
    quota = (F.col("_given") + F.col("_taken") + one).cast("bigint")
    done = full.withColumn("quota", quota)
    short = F.sum("quota").over(whole) < F.col("_n")
    checked = done.withColumn("quota", F.when(short, F.raise_error(F.lit("more draws than the groups hold"))).otherwise(
        F.col("quota")).cast("bigint"))
    return checked.select(*counts.columns, "quota")


def quota_sample(pool: DataFrame, quotas: DataFrame, key: str, order: Column, largest: int) -> DataFrame:
    """The first ``quota`` rows of every group in hash order.

    ``largest`` bounds every quota; Spark keeps that many rows per group and map task before it shuffles.
    """
    window = Window.partitionBy(key).orderBy("_order")
    ranked = pool.withColumn("_order", order).withColumn("_rank", F.row_number().over(window)).filter(
        F.col("_rank") <= largest)
    return ranked.join(quotas.select(key, "quota"), key).filter("_rank <= quota").drop("_order", "_rank", "quota")


def matched_pairs(cells: DataFrame, version: str, measures: Sequence[str]) -> DataFrame:
    """All one-copy/two-copy pairs of each unit with both values of every measure.

    The eight conditions of a unit become columns in one aggregation and the six pairings are read off the row,
    so no self-join is needed.
    """
    present = [F.max(F.when(F.col("condition_id") == c, F.lit(1))).alias(f"has_{c}") for c in P.CONDITION_IDS]
    values = [F.max(F.when(F.col("condition_id") == c, F.col(m))).alias(f"{m}__{c}")
              for m in measures for c in P.CONDITION_IDS]
    unit = cells.groupBy("question_id", "model_id", "dataset").agg(*present, *values)
    pairs = []
    for control, treatment, added in P.PAIRINGS:
        both = (F.col(f"has_{control}") == 1) & (F.col(f"has_{treatment}") == 1)
        pairs.append(F.when(both, F.struct(
            F.lit(control).alias("control_condition"), F.lit(treatment).alias("treatment_condition"),
            F.lit(f"add_{added}_copy").alias("added_copy"),
            *[F.col(f"{m}__{control}").alias(f"control_{m}") for m in measures],
            *[F.col(f"{m}__{treatment}").alias(f"treatment_{m}") for m in measures])))
    rows = unit.select("question_id", "model_id", "dataset", F.explode(F.array_compact(F.array(*pairs))).alias("p"))
    rows = rows.select("question_id", "model_id", "dataset", "p.*")
    pair_id = F.substring(hash_key(version, F.col("question_id"), F.col("model_id"), F.col("control_condition"),
                                   F.col("treatment_condition")), 1, 20)
    return rows.withColumn("pair_id", pair_id)


def change_stratum(control: Column, treatment: Column) -> Column:
    return F.when(treatment > control, "improvement").when(treatment < control, "degradation").otherwise("tie")


def blind_sides(pairs: DataFrame, salt: str, control: str, treatment: str) -> DataFrame:
    """Show treatment as A or B by hash parity; the key columns record which."""
    parity = hash_parity(hash_key(salt, F.col("pair_id")))
    first = parity == 0
    return pairs.select(
        "pair_id",
        F.when(first, F.col(treatment)).otherwise(F.col(control)).alias("response_a"),
        F.when(first, F.col(control)).otherwise(F.col(treatment)).alias("response_b"),
        F.when(first, "A").otherwise("B").alias("treatment_response"),
    )


def fair_dequeue(cells: DataFrame, group: str, order: str) -> DataFrame:
    """Round-robin order over groups: everyone's first item, then everyone's second, and so on."""
    turns = running(cells, [order], {"turn": ("sum", F.lit(1).cast("bigint"))}, keys=[group])
    return turns.orderBy("turn", group)


def balanced_pick(candidates: DataFrame, n: int, seed: str, *, hinted: str = "hinted",
                  balance: Sequence[str] = ("model_id", "dataset", "condition_id"), strata_limit: int = 10_000) -> DataFrame:
    """Greedy pick of n cells from different questions that keeps models, datasets and conditions even.

    Each step takes the cell whose model, dataset and condition were picked least, hinted cells first, then by hash.
    A cell of one model, dataset and condition only competes with the n smallest hashes of that design stratum,
    because n picks use up at most n questions.  Spark keeps those per map task before they meet, and one task walks
    over that table of at most n rows per stratum; more than ``strata_limit`` strata and fewer than n questions are
    errors.
    """
    strata = [*balance, hinted]
    keyed = candidates.withColumn("_hash", hash_key(seed, F.col("cell_id")))
    window = Window.partitionBy(*strata).orderBy("_hash", "cell_id")
    short = materialize(keyed.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).select(
        "cell_id", "question_id", *strata, "_hash"))
    if short.count() > n * strata_limit:
        raise ValueError(f"more than {strata_limit} design strata")
    names = ["pick", "cell_id", "question_id", *strata]

    def walk(rows):
        import pandas as pd

        pools: dict[tuple, list] = {}
        for row in rows.sort_values(["_hash", "cell_id"]).to_dict("records"):
            pools.setdefault(tuple(row[s] for s in strata), []).append(row)
        for queue in pools.values():
            queue.reverse()
        counts: list[dict] = [{} for _ in balance]
        used: set = set()
        picked = []
        while len(picked) < n:
            best = None
            for stratum, queue in pools.items():
                while queue and queue[-1]["question_id"] in used:
                    queue.pop()
                if queue:
                    key = (*(c.get(v, 0) for c, v in zip(counts, stratum)), 0 if stratum[-1] else 1, queue[-1]["_hash"])
                    best = min(best, (key, stratum)) if best else (key, stratum)
            if best is None:
                break
            row = pools[best[1]].pop()
            used.add(row["question_id"])
            for count, value in zip(counts, best[1]):
                count[value] = count.get(value, 0) + 1
            picked.append((len(picked) + 1, *(row[c] for c in names[1:])))
        return pd.DataFrame(picked, columns=names)

    fields = [candidates.schema[c].simpleString().replace(":", " ", 1) for c in names[1:]]
    one = short.groupBy(F.lit(True).alias("_all"))
    return exactly(one.applyInPandas(walk, "pick int, " + ", ".join(fields)), n, "questions to pick from")


def _dealt(rows: DataFrame, roles: Sequence[str], per_role: int) -> DataFrame:
    """Deal pairs, in their places, to roles in rotation: each goes to the next role that takes it and has room.

    ``rows`` (place, pair_id, question_id, flags) is a sample of known size and is folded in one row.
    """
    size = len(roles)
    ordered = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "pair_id", "question_id", "flags"))).alias("rows"))
    state = "struct<cursor:int,counts:array<int>,out:array<struct<place:int,role:int,pair_id:string,question_id:string>>>"
    start = F.struct(F.lit(0).alias("cursor"), F.array_repeat(F.lit(0), size).alias("counts"), F.array().alias("out")).cast(state)
    turns = F.sequence(F.lit(0), F.lit(size - 1))

    def step(now: Column, row: Column) -> Column:
        free = F.filter(F.transform(turns, lambda t: (now["cursor"] + t) % size),
                        lambda r: row["flags"][r] & (now["counts"][r] < per_role))
        role = F.get(free, F.lit(0))
        return F.struct(
            F.coalesce((role + 1) % size, now["cursor"]).alias("cursor"),
            F.transform(now["counts"], lambda c, i: c + F.when(i == role, 1).otherwise(0)).alias("counts"),
            F.concat(now["out"], F.array(F.struct(row["place"].alias("place"), role.alias("role"), row["pair_id"].alias("pair_id"),
                                                  row["question_id"].alias("question_id")))).alias("out")).cast(state)

    return ordered.select(F.explode(F.aggregate("rows", start, step)["out"]).alias("t")).select("t.*")


def _filled(pool: DataFrame, dealt: DataFrame, roles: Sequence[str], per_role: int) -> DataFrame:
    """Fill roles one after the other with unused pairs in hash order, until each has ``per_role``.

    ``pool`` (role, hash, pair_id, question_id) holds no pair in use.  All roles together take at most
    ``per_role`` times their number, so that many smallest hashes of a role decide; those are folded in one row.
    """
    size = len(roles)
    window = Window.partitionBy("role").orderBy("hash", "pair_id")
    near = pool.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= per_role * size)
    rows = near.groupBy().agg(F.array_sort(F.collect_list(F.struct("role", "hash", "pair_id", "question_id"))).alias("rows"))
    given = dealt.groupBy().agg(F.collect_list("role").alias("given"))
    state = "struct<counts:array<int>,used:array<string>,out:array<struct<role:int,pair_id:string,question_id:string>>>"

    def step(now: Column, row: Column) -> Column:
        taken = (now["counts"][row["role"]] < per_role) & ~F.array_contains(now["used"], row["pair_id"])
        task = F.struct(row["role"].alias("role"), row["pair_id"].alias("pair_id"), row["question_id"].alias("question_id"))
        return F.when(taken, F.struct(
            F.transform(now["counts"], lambda c, i: c + F.when(i == row["role"], 1).otherwise(0)).alias("counts"),
            F.concat(now["used"], F.array(row["pair_id"])).alias("used"),
            F.concat(now["out"], F.array(task)).alias("out")).cast(state)).otherwise(now)

    every = F.array(*[F.lit(r) for r in range(size)])
    counts = F.transform(every, lambda r: F.size(F.filter("given", lambda g: g == r)))
    start = F.struct(counts.alias("counts"), F.array().alias("used"), F.array().alias("out")).cast(state)
    # Both sides are aggregates of one row.
    both = rows.withColumn("_one", F.lit(1)).join(given.withColumn("_one", F.lit(1)), "_one")
    return both.select(F.explode(F.aggregate("rows", start, step)["out"]).alias("t")).select("t.*")


def audit_tasks(pairs: DataFrame, version: str, roles: Sequence[str], *, lexical: str = "lexical_eligible",
                lexical_count: int = 79, question_count: int = 148, per_role: int = 15) -> DataFrame:
    """Blinded rating tasks: lexical pairs from distinct questions, then an equal number for every role.

    ``roles`` are boolean eligibility columns.  The pairs of the further questions are dealt to roles in rotation; a
    role is then filled by hash from the pairs of all chosen questions that are still unused.  No pair is used twice.
    Only samples whose size the parameters fix are ordered as a whole.  With fewer than ``question_count`` questions
    there is no audit and no task; a pool that runs short otherwise is an error.
    Result: task, role, pair_id, question_id, treatment_response, display_order.
    """
    flags = F.array(*[F.coalesce(F.col(r), F.lit(False)) for r in roles])
    base = materialize(pairs.select("pair_id", "question_id", F.coalesce(F.col(lexical), F.lit(False)).alias("lexical"),
                                    flags.alias("flags")))
    tasks = "task string, role string, pair_id string, question_id string, treatment_response string, display_order int"
    if base.select("question_id").distinct().count() < question_count:
        return pairs.sparkSession.createDataFrame([], tasks)
    first = one_per_question(base.filter("lexical"), lexical_count, version, "lexical")
    rest = base.filter(F.exists("flags", lambda f: f)).join(first.select("question_id"), "question_id", "left_anti")
    extra = one_per_question(rest, question_count - lexical_count, version, "role-question-coverage")
    dealt = materialize(_dealt(extra.join(base.select("pair_id", "flags"), "pair_id"), roles, per_role))
    if dealt.filter("role is null").count():
        raise ValueError("no role with room for a further question")
    chosen = first.unionByName(extra)
    pool = base.join(chosen.select("question_id"), "question_id", "left_semi").join(
        chosen.select("pair_id"), "pair_id", "left_anti")
    names = F.array(*[F.lit(r) for r in roles])
    by_role = pool.select("pair_id", "question_id", F.posexplode("flags").alias("role", "fits")).filter("fits").select(
        "role", hash_key(version, F.col("pair_id"), F.concat(F.lit("role-fill:"), names[F.col("role")])).alias("hash"),
        "pair_id", "question_id")
    filled = dealt.select("role", "pair_id", "question_id").unionByName(_filled(by_role, dealt, roles, per_role))
    filled = exactly(filled, per_role * len(roles), "role tasks with unused pairs")
    named = first.select(F.lit("lexical").alias("task"), F.lit(None).cast("string").alias("role"), "pair_id", "question_id").unionByName(
        filled.select(F.lit("role").alias("task"), names[F.col("role")].alias("role"), "pair_id", "question_id"))
    kind = F.coalesce("role", F.lit("lexical"))
    side = hash_parity(hash_key(version, F.col("pair_id"), kind, "side"))
    shown = Window.partitionBy(F.lit(True)).orderBy(hash_key(version, F.col("pair_id"), kind, "display"))
    return named.withColumn("treatment_response", F.when(side == 0, "A").otherwise("B")).withColumn(
        "display_order", F.row_number().over(shown))


def preference_order(discovered: Column, preferred: Column) -> Column:
    """Preferred names that were discovered, in that order, then the others alphabetically; case does not matter."""
    lower = lambda names: F.transform(names, lambda n: F.lower(n))
    known = F.filter(discovered, lambda n: F.trim(n) != "")
    last = F.filter(known, lambda n, i: ~F.array_contains(lower(F.slice(known, i + 2, F.size(known))), F.lower(n)))
    wanted = F.array_distinct(lower(preferred))
    first = F.flatten(F.transform(wanted, lambda p: F.filter(last, lambda n: F.lower(n) == p)))
    rest = F.filter(last, lambda n: ~F.array_contains(wanted, F.lower(n)))
    ordered = F.transform(F.array_sort(F.transform(rest, lambda n: F.struct(F.lower(n).alias("k"), n.alias("n")))),
                          lambda s: s["n"])
    return F.concat(first, ordered)

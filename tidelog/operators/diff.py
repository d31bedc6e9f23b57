"""Differences between two copies of a dataset, field by field.

Identical rows cancel by multiplicity; what is left within a key is paired at
least total number of differing fields (minimum-cost assignment); pairs give
their differing fields, the unpaired give missing rows or surplus copies.

Rows are first reduced to distinct rows with counts, on the map side, so copies
never travel.  Keys with at most one distinct leftover a side, nearly all of
them, are settled by that aggregate alone.  Other groups are assigned exactly, as
a transport of copies between distinct rows: up to ``exact_limit`` squared pairs
of distinct rows in one task, and a few rows against very many by picking in
parallel those of the larger side that a least assignment can need.  Groups with
more distinct rows on both sides than that are assigned in blocks of their order;
poor pairs are taken apart and assigned again in blocks of other orders, which
stands if it is cheaper: every row is reported, but such a pairing is not proven
least.

Defined cases: two nulls are equal, null differs from a value; rows with a null
key are compared like others; empty sides give only missing rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.bytesx import hash_text
from tidelog.operators.kv import running_total
from tidelog.operators.segments import HASHES, META, live_segments
from tidelog.session import materialise


#: Distinct rows of a group, both sides, that one task takes; of larger ones it takes the rows near the smaller side.
GROUP_ROWS = 16_384
#: Copies of a block, where a group is beyond the exact ways, and most rounds of blocks in other orders.
BLOCK_ROWS, ROUNDS = 2_048, 8


def least_transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, column, amount) of least total cost that uses up the smaller of supply and demand.  Costs are whole numbers.

    Primal and dual by turns: along pairs without slack as much flows as can, by
    searches that share their visited columns; then the potentials move, from all
    rows with supply left at once, until another column with room is in reach.
    """
    if not cost.size:
        return []
    if supply.sum() > demand.sum():
        return [(i, j, a) for j, i, a in least_transport(np.ascontiguousarray(cost.T), demand, supply)]
    n, m = cost.shape
    left, room = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    u, v = cost.min(1).astype(np.int64), np.zeros(m, dtype=np.int64)
    flow: list[dict[int, int]] = [{} for _ in range(m)]
    col_from, row_from = np.zeros(m, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def push(start: int, col: int) -> None:
        path, i, j = [], int(col_from[col]), col
        amount = min(int(left[start]), int(room[col]))
        while True:
            path.append((i, j))
            if i == start:
                break
            back = int(row_from[i])
            amount = min(amount, flow[back][i])
            i, j = int(col_from[back]), back
        for at, (i, j) in enumerate(path):
            flow[j][i] = flow[j].get(i, 0) + amount
            if at + 1 < len(path):
                back = path[at + 1][1]
                flow[back][i] -= amount
                if not flow[back][i]:
                    del flow[back][i]
        left[start] -= amount
        room[col] -= amount

    def sweep() -> None:
        seen, visited = np.zeros(m, dtype=bool), np.zeros(n, dtype=bool)
        for start in np.flatnonzero(left):
            stack = [int(start)]
            while stack and left[start]:
                i = stack[-1]
                tight = np.flatnonzero((cost[i] - u[i] == v) & ~seen)
                if not len(tight):
                    stack.pop()
                    continue
                free = tight[room[tight] > 0]
                if len(free):
                    col_from[free[0]] = i
                    push(int(start), int(free[0]))
                    stack = [int(start)]
                    continue
                j = int(tight[0])
                seen[j], col_from[j] = True, i
                for r in flow[j]:
                    if not visited[r] and r != start:
                        visited[r], row_from[r] = True, j
                        stack.append(r)

    def slack(rows: np.ndarray) -> np.ndarray:
        parts = [(cost[rows[k : k + 256]] - u[rows[k : k + 256], None]).min(0) for k in range(0, len(rows), 256)]
        return np.min(parts, axis=0) - v

    while True:
        sweep()
        reached, full = left > 0, np.zeros(m, dtype=bool)
        if not reached.any():
            return [(i, j, a) for j in range(m) for i, a in flow[j].items()]
        least = slack(np.flatnonzero(reached))
        while True:
            step = least[~full].min()
            u[reached] += step
            v[full] -= step
            least[~full] -= step
            new = ~full & (least == 0)
            if (room[new] > 0).any():
                break
            full |= new
            rows = np.array(sorted({r for j in np.flatnonzero(new) for r in flow[j]} - set(np.flatnonzero(reached).tolist())), dtype=np.int64)
            if len(rows):
                reached[rows] = True
                least = np.where(full, least, np.minimum(least, slack(rows)))


def least_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, one for each row or column of the shorter side."""
    ones = np.ones(max(cost.shape, default=0), dtype=np.int64)
    return [(i, j) for i, j, _ in least_transport(np.rint(cost).astype(np.int64), ones[: cost.shape[0]], ones[: cost.shape[1]])] if cost.size else []


def _costs(left: pd.Series, right: pd.Series, fields: int) -> np.ndarray:
    """Differing fields of each pair of rows."""
    codes: dict = {}
    encode = lambda rows: np.array([[codes.setdefault(x, len(codes)) for x in r] for r in rows], dtype=np.int32).reshape(len(rows), fields)
    a, b = encode(left), encode(right)
    cost = np.zeros((len(a), len(b)), dtype=np.uint8 if fields < 255 else np.int32)
    for f in range(fields):
        cost += a[:, f, None] != b[None, :, f]
    return cost


PAIRS = "_key array<string>, _left array<string>, _right array<string>, _copies bigint"


def _assign(fields: int):
    """Pandas function over one group: columns ``_row`` (field images), ``_l``, ``_r`` (counts left over)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["_l"] > 0].reset_index(drop=True)
        right = pdf[pdf["_r"] > 0].reset_index(drop=True)
        l_open, r_open = left["_l"].to_numpy(dtype=np.int64).copy(), right["_r"].to_numpy(dtype=np.int64).copy()
        moves = least_transport(_costs(left["_row"], right["_row"], fields), l_open, r_open) if len(left) and len(right) else []
        out = [(left["_row"][i], right["_row"][j], a) for i, j, a in moves]
        for i, j, a in moves:
            l_open[i] -= a
            r_open[j] -= a
        out += [(left["_row"][i], None, int(l_open[i])) for i in np.flatnonzero(l_open)]
        out += [(None, right["_row"][j], int(r_open[j])) for j in np.flatnonzero(r_open)]
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]] * len(out), "_left": [x for x, _, _ in out], "_right": [x for _, x, _ in out], "_copies": np.array([a for _, _, a in out], dtype=np.int64)})

    return run


def pair_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], exact_limit: int = 8_192) -> DataFrame:
    """Leftover pairs: ``_key`` (array of strings), ``_left`` and ``_right`` (arrays of field images or null), ``_copies``.

    Images are strings (binary in hex), so rows of any field types travel alike.
    """

    def image(df: DataFrame) -> list:
        kinds = dict(df.dtypes)
        return [F.hex(F.col(f"`{f}`")) if kinds[f] == "binary" else F.col(f"`{f}`").cast("string") for f in fields]

    def side(df: DataFrame, l: int, r: int) -> DataFrame:  # noqa: E741
        kinds = dict(df.dtypes)
        key = F.array(*[F.hex(F.col(f"`{k}`")) if kinds[k] == "binary" else F.col(f"`{k}`").cast("string") for k in keys])
        return df.select(key.alias("_key"), F.array(*image(df)).alias("_row"), F.lit(l).alias("_l"), F.lit(r).alias("_r"))

    counted = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy("_key", "_row").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    same = F.least("_l", "_r")
    rest = counted.where("_l <> _r").select("_key", "_row", (F.col("_l") - same).alias("_l"), (F.col("_r") - same).alias("_r"))
    rest = materialise(rest, "leftovers")
    groups = rest.groupBy("_key").agg(
        F.count("*").alias("_n"), F.sum("_l").alias("_sl"), F.sum("_r").alias("_sr"),
        F.count_if(F.col("_l") > 0).alias("_dl"), F.count_if(F.col("_r") > 0).alias("_dr"),
        F.max(F.when(F.col("_l") > 0, F.struct("_row")))["_row"].alias("_left"), F.max(F.when(F.col("_r") > 0, F.struct("_row")))["_row"].alias("_right"),
    )
    simple = groups.where("_dl <= 1 and _dr <= 1")
    both = F.least("_sl", "_sr")
    kind = simple.schema["_left"].dataType
    none = F.lit(None).cast(kind)
    settled = simple.select(
        "_key",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("_left"), F.col("_right"), both.alias("_copies")),
                    F.struct(F.col("_left"), none.alias("_right"), (F.col("_sl") - both).alias("_copies")),
                    F.struct(none.alias("_left"), F.col("_right"), (F.col("_sr") - both).alias("_copies")),
                ),
                lambda x: x["_copies"] > 0,
            )
        ).alias("_p"),
    ).select("_key", "_p._left", "_p._right", "_p._copies")
    harder = groups.where("_dl > 1 or _dr > 1")
    less, distinct = both.cast("double"), F.col("_dl") + F.col("_dr")
    cells = float(exact_limit) ** 2
    exact = F.col("_dl").cast("double") * F.col("_dr") <= cells
    lopsided = less * less * F.greatest("_sl", "_sr") <= 64 * cells
    sort = F.when(exact & (distinct <= GROUP_ROWS), "few").when(lopsided, "lopsided").otherwise("blocks")
    harder = harder.select("_key", "_sl", "_sr", distinct.alias("_d"), sort.alias("_sort"))
    n = {r[0]: r[1] for r in harder.groupBy("_sort").count().collect()}
    of = lambda which: rest.join(harder.where(F.col("_sort") == which).drop("_sort"), "_key")
    run = _assign(len(fields))
    if "few" in n:
        settled = settled.unionByName(of("few").select("_key", "_row", "_l", "_r").groupBy("_key").applyInPandas(run, PAIRS))
    if "lopsided" in n:
        near, far = _near_rows(of("lopsided"), len(fields))
        settled = settled.unionByName(near.groupBy("_key").applyInPandas(run, PAIRS)).unionByName(far)
    if "blocks" in n:
        settled = settled.unionByName(_pair_in_blocks(of("blocks").select("_key", "_row", "_l", "_r"), len(fields), BLOCK_ROWS))
    return settled


def _near_rows(groups: DataFrame, fields: int) -> tuple[DataFrame, DataFrame]:
    """Groups of s copies against very many: rows that a least assignment needs, and the rest as lone pairs.

    Were a row of the smaller side paired with none of its s nearest, one of these
    would be free and no dearer; so its s nearest of each part are enough.
    """
    small = F.least("_sl", "_sr")
    few = ((F.col("_l") > 0) & (F.col("_sl") <= F.col("_sr"))) | ((F.col("_r") > 0) & (F.col("_sr") < F.col("_sl")))
    parts = F.ceil(F.col("_d") / GROUP_ROWS).cast("int")
    own = F.when(few, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("_row"), parts).cast("int")))
    parted = groups.select("_key", "_row", "_l", "_r", few.alias("_few"), small.cast("bigint").alias("_s"), F.explode(own).alias("_part"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        few, many, s = pdf[pdf["_few"]], pdf[~pdf["_few"]].reset_index(drop=True), int(pdf["_s"].iloc[0])
        keep = np.zeros(len(many), dtype=bool)
        if len(few) and len(many):
            cost = _costs(few["_row"].reset_index(drop=True), many["_row"], fields)
            keep[np.unique(cost.argsort(1, kind="stable")[:, :s])] = True
        near = many[keep].assign(_near=True)
        near[["_l", "_r"]] = near[["_l", "_r"]].clip(upper=s)
        far = many.assign(_near=False)
        far.loc[keep, ["_l", "_r"]] = (far.loc[keep, ["_l", "_r"]] - s).clip(lower=0)
        out = [near, far[(far["_l"] > 0) | (far["_r"] > 0)]]
        if pdf["_part"].iloc[0] == 0:
            out.append(few.assign(_near=True))
        return pd.concat(out)[["_key", "_row", "_l", "_r", "_near"]]

    picked = parted.groupBy("_key", "_part").applyInPandas(pick, "_key array<string>, _row array<string>, _l bigint, _r bigint, _near boolean")
    picked = materialise(picked, "near")
    far = picked.where("not _near").select(
        "_key", F.when(F.col("_l") > 0, F.col("_row")).alias("_left"), F.when(F.col("_r") > 0, F.col("_row")).alias("_right"), (F.col("_l") + F.col("_r")).alias("_copies")
    )
    return picked.where("_near").select("_key", "_row", "_l", "_r"), far


def _in_blocks(rows: DataFrame, order: list[str], amount: str, size: int) -> DataFrame:
    """``rows`` with ``_block``: stretches of ``size`` copies in the order; a row with more copies is in several, each with its part of ``amount``."""
    ranked = running_total(rows, ["_key", *order], F.col(amount), "_end")
    first = ranked.groupBy("_key").agg(F.min(F.col("_end") - F.col(amount)).alias("_base"))
    placed = ranked.join(first, "_key").withColumns({"_to": F.col("_end") - F.col("_base"), "_from": F.col("_end") - F.col("_base") - F.col(amount)})
    block = F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size)))
    cut = placed.withColumn("_block", block)
    inside = F.least(F.col("_to"), (F.col("_block") + 1) * size) - F.greatest(F.col("_from"), F.col("_block") * size)
    return cut.withColumn(amount, inside).drop("_end", "_base", "_from", "_to")


def _assigned(rows: DataFrame, fields: int, size: int, lead: int) -> DataFrame:
    """Pairs of rows ``_l``, ``_r``: blocks in the order that begins with field ``lead`` are assigned, what is alone then meets by rank."""
    run = _assign(fields)
    turned = F.concat(F.slice("_row", lead + 1, fields), F.slice("_row", 1, max(1, lead)))
    cut = _in_blocks(rows.withColumn("_n", F.col("_l") + F.col("_r")).withColumn("_order", turned), ["_order", "_row"], "_n", size).drop("_order")
    moved = cut.withColumns({"_l": F.when(F.col("_l") > 0, F.col("_n")).otherwise(0), "_r": F.when(F.col("_r") > 0, F.col("_n")).otherwise(0)}).drop("_n")
    pairs = materialise(moved.groupBy("_key", "_block").applyInPandas(run, PAIRS), "blocks")
    lone = pairs.where("_left is null or _right is null")
    side = lambda own, l, r: _in_blocks(lone.where(f"{own} is not null").select("_key", F.col(own).alias("_row"), F.col("_copies").alias("_n")), ["_row"], "_n", size).select("_key", "_block", "_row", (F.col("_n") * l).alias("_l"), (F.col("_n") * r).alias("_r"))
    late = side("_left", 1, 0).unionByName(side("_right", 0, 1)).groupBy("_key", "_block").applyInPandas(run, PAIRS)
    return materialise(pairs.where("_left is not null and _right is not null").unionByName(late), "pairs")


def _pair_in_blocks(many: DataFrame, fields: int, size: int) -> DataFrame:
    """Pairs of groups too large to be assigned at once; see the module.

    Pairs unlike in more than half of their fields, and rows that are alone, are
    taken apart and assigned anew in the order of other fields; the new pairs
    stand if they are cheaper.
    """
    unlike = F.size(F.filter(F.arrays_zip(F.col("_left").alias("l"), F.col("_right").alias("r")), lambda x: ~x["l"].eqNullSafe(x["r"])))
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    cost = lambda df: df.agg(F.sum(F.when(both, unlike * F.col("_copies")).otherwise(0))).first()[0] or 0
    pairs = _assigned(many, fields, size, 0)
    turns = min(ROUNDS, fields - 1)
    for turn in range(1, turns + 1):
        poor = pairs.where(~both | (unlike * 2 > fields))
        before = cost(poor)
        if not before:
            break
        rows = poor.where("_left is not null").select("_key", F.col("_left").alias("_row"), F.col("_copies").alias("_l"), F.lit(0).cast("bigint").alias("_r"))
        rows = rows.unionByName(poor.where("_right is not null").select("_key", F.col("_right").alias("_row"), F.lit(0).cast("bigint").alias("_l"), F.col("_copies").alias("_r")))
        newer = _assigned(rows, fields, size, turn * fields // (turns + 1))
        if cost(newer) < before:
            pairs = materialise(pairs.where(both & (unlike * 2 <= fields)).unionByName(newer), "pairs")
    return pairs


def diff_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], exact_limit: int = 8_192) -> DataFrame:
    """One row per difference: the key columns as strings, ``finding``, both values, ``copies``.

    ``finding`` is ``missing_on_right``, ``missing_on_left`` (no row of the key is
    there), ``surplus_on_left``, ``surplus_on_right`` (more copies than on the
    other side) or the name of a field that differs.
    """
    pairs = pair_copies(left, right, keys, fields, exact_limit)
    changed = F.filter(
        F.transform(
            F.arrays_zip(F.array(*[F.lit(f) for f in fields]).alias("f"), F.col("_left").alias("l"), F.col("_right").alias("r")),
            lambda x: F.struct(x["f"].alias("finding"), x["l"].alias("left_value"), x["r"].alias("right_value")),
        ),
        lambda x: ~x["left_value"].eqNullSafe(x["right_value"]),
    )
    lone = F.array(F.struct(F.when(F.col("_left").isNull(), "left").otherwise("right").alias("finding"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    found = pairs.withColumn("_d", F.explode(F.when(F.col("_left").isNotNull() & F.col("_right").isNotNull(), changed).otherwise(lone)))
    out = found.select(
        *[F.col("_key")[i].alias(k) for i, k in enumerate(keys)], "_d.finding", "_d.left_value", "_d.right_value", "_copies",
        (F.col("_left").isNull() | F.col("_right").isNull()).alias("_lone"),
    ).withColumnRenamed("_copies", "copies")
    there = lambda df: df.select(*[F.coalesce(F.hex(c) if t == "binary" else c.cast("string"), F.lit("\0")).alias(f"_{k}") for k, t, c in ((k, dict(df.dtypes)[k], F.col(f"`{k}`")) for k in keys)]).distinct()
    on = [F.coalesce(F.col(k), F.lit("\0")) for k in keys]

    def name(df: DataFrame, other: DataFrame, side: str, opposite: str) -> DataFrame:
        marked = there(other).withColumn("_known", F.lit(True))
        cond = [a == marked[f"_{k}"] for a, k in zip(on, keys)]
        label = F.when(F.col("_known"), f"surplus_on_{opposite}").otherwise(f"missing_on_{side}")
        return df.join(marked, cond, "left").withColumn("finding", label).select(*keys, "finding", "left_value", "right_value", "copies")

    plain = out.where("not _lone").drop("_lone")
    return (
        plain.unionByName(name(out.where("_lone and finding = 'right'"), right, "right", "left"))
        .unionByName(name(out.where("_lone and finding = 'left'"), left, "left", "right"))
    )


def compare_segments(entries: DataFrame, peer: DataFrame) -> DataFrame:
    """``segment_id``, ``finding`` between a primary's live segments and a peer's copy of them.

    Hashes are compared in one spelling and ``created_at`` not at all; identical
    rows count once.
    """
    fields = [f for f in META if f != "created_at"]
    plain = lambda df: df.where("segment_id is not null").select("segment_id", *[hash_text(F.col(f)).alias(f) if f in HASHES else f for f in fields]).distinct()
    ours, theirs = plain(live_segments(entries)), plain(peer)
    names = {"missing_on_right": "missing_on_peer", "missing_on_left": "missing_on_primary", "surplus_on_left": "surplus_on_primary", "surplus_on_right": "surplus_on_peer"}
    found = diff_copies(ours, theirs, ["segment_id"], fields).replace(names, subset=["finding"])
    return found.select(F.col("segment_id").cast("bigint").alias("segment_id"), "finding", "left_value", "right_value", "copies")


def segment_findings(entries: DataFrame, peer: DataFrame) -> DataFrame:
    return compare_segments(entries, peer).where("not startswith(finding, 'surplus')").select("segment_id", "finding").distinct()

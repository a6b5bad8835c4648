"""The nearest rows in time of other members, by an ordered sweep without pairs.

What a row finds depends only on its chamber, instant and member. Of each instant no more than 2k rows can be found by anyone: the first 2k
by id, at most k of a member (whoever asks shuts out one member). These go to the task of their time slice and, over its border, to those of the
slices before and after. A sweep through a slice then goes outward from each asked instant, nearer side first, until it has k. So a row
is sent once and an instant at most three times, whatever the number of rows within reach of each other. A slice with many
askers is dealt to several tasks; the few rows that can be found in it are sent to each.

Cases: rows without time or member take no part; equal gaps are ordered by id; repeated rows are found each time, and each asks; an empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Askers of a slice that one task takes, about.
ASKERS = 50_000


def sweep(asked: list[tuple[int, int]], found: dict[int, list[tuple[int, int]]], k: int, within: int) -> list[list[tuple[int, int]]]:
    """For each (time, member) the k nearest (gap, id) of others. ``found``: time -> (id, member) in order of id."""
    times, out = sorted(found), []
    for at, member in asked:
        right = bisect_left(times, at)
        left, got = right - 1, []
        while len(got) < k:
            after = times[right] - at if right < len(times) else within + 1
            before = at - times[left] if left >= 0 else within + 1
            gap = min(after, before)
            if gap > within:
                break
            here = []
            if after == gap:
                here += found[times[right]]
                right += 1
            if before == gap:
                here += found[times[left]]
                left -= 1
            got += [(gap, i) for i, m in sorted(here) if m != member]
        out.append(got[:k])
    return out


def nearest_in_time(rows: DataFrame, k: int, within: int = 86400) -> DataFrame:
    """(release_id, rank, other_id, gap): for each row the k nearest of its chamber's other members, at most ``within`` seconds away.
    rows: release_id, member_id, chamber, at (seconds)."""
    rows = rows.select("release_id", "member_id", "chamber", "at").where("at is not null and member_id is not null").withColumn("chamber", F.coalesce("chamber", F.lit("")))
    place = lambda *by: F.row_number().over(Window.partitionBy("chamber", "at", *by).orderBy("release_id"))
    few = rows.withColumn("n", place("member_id")).where(F.col("n") <= k).withColumn("n", place()).where(F.col("n") <= 2 * k)
    slice_of = F.floor(F.col("at") / within)
    asked = rows.select("chamber", "at", "member_id").distinct().withColumn("slice", slice_of)
    busy = asked.groupBy("chamber", "slice").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("parts"))
    asked = asked.join(busy, ["chamber", "slice"]).withColumn("part", F.pmod(F.xxhash64("at", "member_id"), F.col("parts")).cast("int")).drop("parts")
    seen = few.select("chamber", "at", "member_id", "release_id", F.explode(F.array(slice_of - 1, slice_of, slice_of + 1)).alias("slice"))
    seen = seen.join(busy, ["chamber", "slice"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(asked: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list[tuple[int, int]]] = {}
        for at, i, m in zip(seen["at"], seen["release_id"], seen["member_id"], strict=True):
            found.setdefault(at, []).append((i, m))
        for here in found.values():
            here.sort()
        got = sweep(list(zip(asked["at"], asked["member_id"], strict=True)), found, k, within)
        return pd.DataFrame({"chamber": asked["chamber"], "at": asked["at"], "member_id": asked["member_id"], "gaps": [[g for g, _ in x] for x in got], "ids": [[i for _, i in x] for x in got]})

    keys = ["chamber", "slice", "part"]
    asked, seen = (df.select(*[F.col(c).alias(f"{c}_") for c in df.columns]).toDF(*df.columns) for df in (asked, seen))  # own columns: both come from rows
    answers = asked.groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInPandas(run, "chamber string, at long, member_id long, gaps array<long>, ids array<long>")
    each = rows.join(answers, ["chamber", "at", "member_id"]).select("release_id", F.posexplode(F.arrays_zip("ids", "gaps")).alias("pos", "x"))
    return each.select("release_id", (F.col("pos") + 1).alias("rank"), F.col("x.ids").alias("other_id"), F.col("x.gaps").alias("gap"))

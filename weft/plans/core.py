"""Packets of many requests at once, whose tickets' discussions stay whole.

A request is a ticket; its packet shares one budget among the threads that name it. Windows
over request and thread place every post: its distance from a mention, whether it lies in the
ticket's window or in the core between first and last mention. Only ids, sizes and flags go
to the choice, one request a group: each thread takes posts by priority and spends what is
left on its largest inner gap, edges first; budget that threads do not use goes to threads asked
for by link, the primary one and the others in turn; and where the primary thread still has a hole
in its core, it is chosen anew as one stretch that loses posts from its ends only.

A request has at most MOST_THREADS threads, cut before the choice; their posts are one group.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators.threads import rendered_units

# Distances from ticket mentions and matches, posts at the end, units of a long message, posts that may lie between two chosen ones.
TICKET_RADIUS, MATCH_RADIUS, LATEST, LONG_MESSAGE, MERGE_GAP = 8, 2, 3, 400, 2
BUDGET, MOST_THREADS, LEFT_OUT = 4_000, 4, 99
#: Shares of the floor of a thread that was asked for by link.
LINK_SHARE = 0.75


def threads_of(edges: DataFrame, linked: DataFrame | None = None, most: int = MOST_THREADS) -> DataFrame:
    """(request, thread_id, rank, direct): the threads of each ticket, those asked for by link (request, thread_id) first, then by mentions.

    edges: (ticket_key, id, thread_id). Tasks cut each request to its best threads before they are shuffled.
    """
    counts = edges.groupBy(F.col("ticket_key").alias("request"), "thread_id").agg(F.count(F.lit(1)).alias("mentions"))
    if linked is not None:
        asked = linked.select("request", "thread_id").distinct().withColumn("direct", F.lit(True))
        counts = counts.join(asked, ["request", "thread_id"], "full")
    else:
        counts = counts.withColumn("direct", F.lit(False))
    counts = counts.withColumns({"direct": F.coalesce("direct", F.lit(False)), "mentions": F.coalesce("mentions", F.lit(0))})
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("direct"), F.desc("mentions"), "thread_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("request", "thread_id", "rank", "direct")


def placed(posts: DataFrame, users: DataFrame, files: DataFrame, threads: DataFrame, match: str) -> DataFrame:
    """A row for each live post of each request's threads: place, size, priority, and the flags of the choice."""
    held = files.where("delete_at = 0").select(F.col("post_id").alias("id")).distinct().withColumn("has_file", F.lit(True))
    keys = T.ticket_keys(F.col("message"))
    base = posts.where("delete_at = 0").join(threads, "thread_id").join(rendered_units(posts, users), "id").join(held, "id", "left")
    base = base.select(
        "request", "rank", "direct", "thread_id", "id", "create_at", "units", keys.alias("keys"), F.col("message").contains("```").alias("fence"), (F.length("message") >= LONG_MESSAGE).alias("long"),
        F.coalesce("has_file", F.lit(False)).alias("has_file"), F.coalesce(F.expr(match), F.lit(False)).alias("match"),
    )
    order = Window.partitionBy("request", "thread_id").orderBy("create_at", "id")
    every = Window.partitionBy("request", "thread_id")
    c = F.col
    rows = base.withColumns({"pos": F.row_number().over(order), "total": F.count(F.lit(1)).over(every), "ticket": F.array_contains("keys", c("request")), "others": F.size(F.array_remove("keys", c("request")))})

    def near(flag: str):
        at = F.when(c(flag), c("pos"))
        back = F.max(at).over(order.rowsBetween(Window.unboundedPreceding, 0))
        ahead = F.min(at).over(Window.partitionBy("request", "thread_id").orderBy(F.desc("create_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
        return F.least(c("pos") - back, ahead - c("pos"))

    hit = F.when(c("ticket"), c("pos"))
    rows = rows.withColumns({"first": F.min(hit).over(every), "last": F.max(hit).over(every), "t_near": near("ticket"), "m_near": near("match"), "other": F.sum("others").over(every)})
    anchored = F.coalesce((c("first") == 1) & (c("last") == 1), F.lit(False))
    rows = rows.withColumns({"anchored": anchored, "anchor": c("has_file") | c("fence"), "root": c("pos") == 1})
    rows = rows.withColumns(
        {
            "in_window": anchored | F.coalesce(c("pos").between(c("first") - TICKET_RADIUS, c("last") + TICKET_RADIUS), F.lit(False)),
            "core": anchored | F.coalesce(c("pos").between(c("first"), c("last")), F.lit(False)),
            "structural": c("anchor") | (F.size("keys") >= 2) | c("long"),
        }
    )
    level = F.when(c("root"), 0).when(c("t_near") <= TICKET_RADIUS, 1 + c("t_near")).when(c("m_near") <= MATCH_RADIUS, 2 + TICKET_RADIUS + c("m_near"))
    level = level.when(c("structural") & (c("in_window") | c("anchor")), 5 + TICKET_RADIUS + MATCH_RADIUS).when(c("pos") > c("total") - LATEST, 6 + TICKET_RADIUS + MATCH_RADIUS).otherwise(LEFT_OUT)
    windowed = F.round(F.sum(c("in_window").cast("int")).over(every) / c("total"), 2)
    score = F.when(anchored, 50).otherwise(0) + F.when(c("other") == 0, 40).otherwise(0) + F.floor(windowed * 10 + 0.5) + F.least(c("total"), F.lit(12))
    return rows.select("request", "rank", "direct", "thread_id", "id", "pos", "units", level.cast("int").alias("priority"), "in_window", "core", "anchor", "structural", "root", "anchored", score.cast("double").alias("score"))


def contiguous(t: dict[str, np.ndarray], limit: int) -> np.ndarray:
    """Window posts, files and the root, less what does not fit: what lies off the window goes first, then the window's ends outside the core, then
    the core's ends, the larger one each time; posts with files and an anchoring root hold their end as long as the other one is free."""
    units, anchored = t["units"], bool(t["anchored"][0])
    chosen = t["in_window"] | t["anchor"] | t["root"]
    held = t["anchor"] | (t["root"] & anchored)
    over = int(units[chosen].sum()) - limit

    def drop(i: int) -> None:
        nonlocal over
        chosen[i] = False
        over -= int(units[i])

    off = chosen & ~t["in_window"] & ~t["anchor"]
    for i in [*np.flatnonzero(off & ~t["root"]), *(np.flatnonzero(off & t["root"]) if not anchored else [])]:
        if over > 0:
            drop(i)
    sides = deque(np.flatnonzero(chosen & t["in_window"] & ~t["core"] & ~held))
    while over > 0 and sides:
        drop(sides.popleft() if units[sides[0]] >= units[sides[-1]] else sides.pop())
    core = deque(np.flatnonzero(chosen & t["core"]))
    while over > 0 and core:
        left, right = core[0], core[-1]
        at_left = held[right] and not held[left] if held[left] != held[right] else left == right or units[left] > units[right]
        drop(core.popleft() if at_left else core.pop())
    for i in np.flatnonzero(chosen):
        if over > 0:
            drop(i)
    return chosen


def edges_inward(at: np.ndarray) -> np.ndarray:
    """First, last, second, last but one and so on."""
    out = np.empty(len(at), at.dtype)
    out[::2], out[1::2] = at[: (len(at) + 1) // 2], at[::-1][: len(at) // 2]
    return out


def inner_gaps(chosen: np.ndarray) -> list[np.ndarray]:
    """Runs of posts not chosen between two that are."""
    on = np.flatnonzero(chosen)
    return [np.arange(a + 1, b) for a, b in zip(on[:-1], on[1:], strict=True) if b - a > 1] if len(on) else []


def fill_gaps(t: dict[str, np.ndarray], chosen: np.ndarray, limit: int) -> np.ndarray:
    """Spends what is left on the gap with most window posts, or the longest where there is no window: structural posts, then from its edges inward; again until nothing fits."""
    chosen, units, window = chosen.copy(), t["units"], t["in_window"]
    used = int(units[chosen].sum())
    while used < limit:
        gaps = sorted(inner_gaps(chosen), key=lambda g: (-int(window[g].sum()), -len(g)))
        gap = next((g for g in gaps if window[g].any()), None) if window.any() else (gaps[0] if gaps else None)
        if gap is None:
            break
        gap = gap[window[gap]] if window.any() else gap
        before = used
        for i in dict.fromkeys([*gap[t["structural"][gap]].tolist(), *edges_inward(gap).tolist()]):
            if used + units[i] <= limit:
                chosen[i] = True
                used += int(units[i])
        if used == before:
            break
    return chosen


def hole_in_core(t: dict[str, np.ndarray], chosen: np.ndarray) -> bool:
    on = np.flatnonzero(chosen & t["core"])
    return len(on) > 1 and not chosen[on[0] : on[-1]].all()


def by_priority(t: dict[str, np.ndarray], limit: int) -> np.ndarray:
    """Posts in order of priority and place as long as they fit, short gaps between them, then the inner gaps."""
    units, wanted = t["units"], t["priority"] < LEFT_OUT
    order = np.lexsort((np.arange(len(units)), t["priority"]))
    order = [i for i in order.tolist() if wanted[i]]
    marked = np.flatnonzero(wanted)
    order += [i for a, b in zip(marked[:-1].tolist(), marked[1:].tolist(), strict=True) if 1 < b - a <= MERGE_GAP + 1 for i in range(a + 1, b)]
    chosen, used = np.zeros(len(units), bool), 0
    for i in order:
        if used + units[i] <= limit:
            chosen[i] = True
            used += int(units[i])
    return fill_gaps(t, chosen, limit)


def choose(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """The packet of one request: selected posts, the limit of each thread, and whether its core was repaired."""
    rows = rows.sort_values(["rank", "pos"])
    threads = [{c: g[c].to_numpy() for c in g.columns} for _, g in rows.groupby("rank", sort=True)]
    share = budget // len(threads)
    floor = min(share, max(int(share * LINK_SHARE), budget // max(2, len(threads))))
    limits, picked = [share] * len(threads), [by_priority(t, share) for t in threads]
    used = [int(t["units"][p].sum()) for t, p in zip(threads, picked, strict=True)]
    left = budget - sum(used)
    score = [t["score"][0] - 0.01 * (~p).sum() for t, p in zip(threads, picked, strict=True)]
    primary = int(np.argmax(np.round(score, 4)))
    for k in dict.fromkeys([*(k for k, t in enumerate(threads) if t["direct"][0]), primary, *range(len(threads))]):
        if left <= 0 or picked[k].all():
            continue
        limit = max(floor if threads[k]["direct"][0] else 0, used[k] + left)
        more = by_priority(threads[k], limit)
        now = int(threads[k]["units"][more].sum())
        if used[k] < now <= used[k] + left:
            left, picked[k], used[k], limits[k] = left - (now - used[k]), more, now, limit
    repaired = False
    t = threads[primary]
    if not picked[primary].all() and hole_in_core(t, picked[primary]):
        limit = min(limits[primary], used[primary] + max(0, left))
        whole = fill_gaps(t, contiguous(t, limit), limit)
        if int(t["units"][whole].sum()) <= used[primary] + max(0, left):
            picked[primary], repaired = whole, True
    out = [pd.DataFrame({c: t[c] for c in ("request", "thread_id", "rank", "id", "pos", "units")} | {"selected": p, "is_primary": k == primary, "repaired": repaired and k == primary}) for k, (t, p) in enumerate(zip(threads, picked, strict=True))]
    return pd.concat(out)


PACKET = "request string, thread_id string, rank int, id string, pos int, units long, selected boolean, is_primary boolean, repaired boolean"


def packets(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Every request's packet, one group a request."""
    return rows.groupBy("request").applyInPandas(lambda g: choose(g, budget), PACKET)

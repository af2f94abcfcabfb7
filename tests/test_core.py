"""Packets by request against a plain pass over lists of posts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.plans import core


def thread(r, n):
    """A random thread as lists: units, flags, priorities."""
    hits = sorted(r.sample(range(n), min(n, r.choice([0, 1, 1, 2, 3]))))
    posts = []
    for i in range(n):
        lo, hi = (hits[0], hits[-1]) if hits else (None, None)
        alone = hits == [0]
        posts.append({
            "units": r.randint(20, 200), "in_window": alone or (bool(hits) and lo - 2 <= i <= hi + 2), "core": alone or (bool(hits) and lo <= i <= hi), "anchor": r.random() < 0.15, "root": i == 0, "anchored": alone,
            "priority": r.choice([0, 1, 2, 3, core.LEFT_OUT, core.LEFT_OUT]), "direct": False, "score": 0.0,
        })
        posts[-1]["structural"] = posts[-1]["anchor"] or r.random() < 0.1
    return posts


def columns(posts):
    return {k: np.array([p[k] for p in posts]) for k in posts[0]}


def size(posts, chosen):
    return sum(p["units"] for p, c in zip(posts, chosen) if c)


def plain_core(posts, limit):
    """One post at a time: whatever rule comes first names the post that goes."""
    chosen = [p["in_window"] or p["anchor"] or p["root"] for p in posts]
    anchored = posts[0]["anchored"]
    protected = lambda i: posts[i]["anchor"] or (anchored and posts[i]["root"])
    while size(posts, chosen) > limit and any(chosen):
        on = [i for i, c in enumerate(chosen) if c]
        off = [i for i in on if not posts[i]["in_window"] and not posts[i]["root"] and not posts[i]["anchor"]]
        sides = [i for i in on if posts[i]["in_window"] and not posts[i]["core"] and not protected(i)]
        inner = [i for i in on if posts[i]["core"]]
        if off:
            gone = off[0]
        elif chosen[0] and not anchored and not posts[0]["in_window"] and not posts[0]["anchor"]:
            gone = 0
        elif sides:
            gone = sides[0] if posts[sides[0]]["units"] >= posts[sides[-1]]["units"] else sides[-1]
        elif inner:
            a, b = inner[0], inner[-1]
            if protected(a) and not protected(b):
                gone = b
            elif protected(b) and not protected(a) or a == b:
                gone = a
            else:
                gone = a if posts[a]["units"] > posts[b]["units"] else b
        else:
            gone = on[0]
        chosen[gone] = False
    return chosen


def plain_fill(posts, chosen, limit):
    chosen = list(chosen)
    windowed = any(p["in_window"] for p in posts)
    while size(posts, chosen) < limit:
        gaps, run, seen = [], [], False
        for i, c in enumerate(chosen):
            if c:
                if seen and run:
                    gaps.append(run)
                run, seen = [], True
            elif seen:
                run.append(i)
        inside = lambda g: [i for i in g if posts[i]["in_window"]]
        gaps.sort(key=lambda g: (-len(inside(g)), -len(g)))
        if windowed:
            gaps = [inside(g) for g in gaps if inside(g)]
        if not gaps:
            break
        gap, inward = gaps[0], []
        left = list(gap)
        while left:
            inward.append(left.pop(0))
            if left:
                inward.append(left.pop())
        took = False
        for i in [i for i in gap if posts[i]["structural"]] + inward:
            if not chosen[i] and size(posts, chosen) + posts[i]["units"] <= limit:
                chosen[i] = took = True
        if not took:
            break
    return chosen


def plain_priority(posts, limit):
    wanted = [i for i, p in enumerate(posts) if p["priority"] < core.LEFT_OUT]
    order = sorted(wanted, key=lambda i: (posts[i]["priority"], i))
    for a, b in zip(wanted, wanted[1:]):
        if b - a - 1 <= core.MERGE_GAP:
            order += range(a + 1, b)
    chosen = [False] * len(posts)
    for i in order:
        if size(posts, chosen) + posts[i]["units"] <= limit:
            chosen[i] = True
    return plain_fill(posts, chosen, limit)


def plain_hole(posts, chosen):
    inside = [i for i, p in enumerate(posts) if p["core"] and chosen[i]]
    return any(not chosen[i] for i in range(inside[0], inside[-1])) if inside else False


def plain_packet(threads, budget):
    share = budget // len(threads)
    limits, picked = [share] * len(threads), [plain_priority(t, share) for t in threads]
    spent = [size(t, p) for t, p in zip(threads, picked)]
    left = budget - sum(spent)
    scores = [round(t[0]["score"] - 0.01 * p.count(False), 4) for t, p in zip(threads, picked)]
    primary = scores.index(max(scores))
    order = [k for k, t in enumerate(threads) if t[0]["direct"]] + [primary] + list(range(len(threads)))
    for k in dict.fromkeys(order):
        if left > 0 and not all(picked[k]):
            limit = spent[k] + left
            if threads[k][0]["direct"]:
                limit = max(limit, min(share, max(int(share * 0.75), budget // max(2, len(threads)))))
            more = plain_priority(threads[k], limit)
            if spent[k] < size(threads[k], more) <= spent[k] + left:
                left -= size(threads[k], more) - spent[k]
                picked[k], spent[k], limits[k] = more, size(threads[k], more), limit
    if plain_hole(threads[primary], picked[primary]):
        limit = min(limits[primary], spent[primary] + max(0, left))
        whole = plain_fill(threads[primary], plain_core(threads[primary], limit), limit)
        if size(threads[primary], whole) <= spent[primary] + max(0, left):
            return picked[:primary] + [whole] + picked[primary + 1 :], primary, True
    return picked, primary, False


@pytest.mark.parametrize("seed", range(6))
def test_cores_gaps_and_priorities_equal_a_plain_pass(seed):
    r = random.Random(seed)
    for _ in range(60):
        posts = thread(r, r.randint(1, 25))
        limit = r.randint(0, sum(p["units"] for p in posts) + 50)
        t = columns(posts)
        assert core.contiguous(t, limit).tolist() == plain_core(posts, limit)
        assert core.by_priority(t, limit).tolist() == plain_priority(posts, limit)
        some = np.array([r.random() < 0.4 for _ in posts])
        assert core.fill_gaps(t, some, limit).tolist() == plain_fill(posts, some.tolist(), limit)
        assert core.hole_in_core(t, some) == plain_hole(posts, some.tolist())


def test_a_core_is_never_holed_by_trimming():
    r = random.Random(9)
    for _ in range(200):
        t = columns(thread(r, r.randint(2, 25)))
        kept = np.flatnonzero(core.contiguous(t, r.randint(0, 2000)) & t["core"])
        assert len(kept) == 0 or kept[-1] - kept[0] + 1 == len(kept)


POSTS = "id string, root_id string, thread_id string, conversation_id string, user_id string, create_at long, update_at long, delete_at long, message string"


def corpus():
    r = random.Random(4)
    rows = []
    for t in range(14):
        for i in range(r.randint(1, 30)):
            keys = "".join(f" {k}" for k in ("PROJ-1", "OPS-2", "OPS-9") if r.random() < (0.25 if i else 0.5))
            text = "word " * r.randint(1, 60) + keys + (" approved" if r.random() < 0.2 else "") + (" ```x```" if r.random() < 0.1 else "")
            rows.append((f"t{t:02d}-{i:02d}", "" if i == 0 else f"t{t:02d}-00", f"t{t:02d}-00", "c", "ann", 100 * i, 100 * i, 9 if r.random() < 0.05 and i else 0, text))
    return rows


def test_packets_of_many_requests_equal_a_plain_pass(spark):
    rows = corpus()
    posts, users = spark.createDataFrame(rows, POSTS).repartition(3), spark.createDataFrame([("ann", "ann")], "id string, username string")
    files = spark.createDataFrame([("f", "t03-01", "a.png", 1, 0), ("g", "t04-00", "b.png", 1, 5)], "id string, post_id string, name string, size long, delete_at long")
    edges = posts.where("delete_at = 0").select("id", "thread_id", F.explode(F.array_distinct(core.T.ticket_keys(F.col("message")))).alias("ticket_key"))
    linked = spark.createDataFrame([("PROJ-1", "t13-00")], "request string, thread_id string")
    placed = core.placed(posts, users, files, core.threads_of(edges, linked), "message LIKE '%approved%'").collect()
    requests = {}
    for p in sorted(placed, key=lambda p: (p["request"], p["rank"], p["pos"])):
        requests.setdefault(p["request"], {}).setdefault(p["rank"], []).append(p.asDict())
    assert set(requests) == {"PROJ-1", "OPS-2", "OPS-9"} and requests["PROJ-1"][1][0]["thread_id"] == "t13-00" and all(len(x) <= core.MOST_THREADS for x in requests.values())
    for p in placed:  # flags against the texts
        mine = sorted((q for q in rows if q[2] == p["thread_id"] and not q[7]), key=lambda q: (q[5], q[0]))
        said = [i + 1 for i, q in enumerate(mine) if p["request"] in q[8].split()]
        alone = said == [1]
        assert mine[p["pos"] - 1][0] == p["id"] and p["units"] == len("ann") + 24 + len(mine[p["pos"] - 1][8])
        assert p["core"] == (alone or bool(said) and said[0] <= p["pos"] <= said[-1]) and p["in_window"] == (alone or bool(said) and said[0] - 8 <= p["pos"] <= said[-1] + 8)
        assert p["anchor"] == ("```" in mine[p["pos"] - 1][8] or p["id"] == "t03-01")
    repaired = 0
    for budget in (600, 2500, 6000):
        got = {}
        for x in core.packets(spark.createDataFrame(placed, core_schema(spark, posts, users, files, edges, linked)).repartition(4), budget).collect():
            got.setdefault(x["request"], {})[x["id"]] = (x["selected"], x["is_primary"], x["repaired"])
        for name, threads in requests.items():
            threads = [threads[k] for k in sorted(threads)]
            picked, primary, mended = plain_packet(threads, budget)
            want = {p["id"]: (c, k == primary, mended and k == primary) for k, (t, chosen) in enumerate(zip(threads, picked)) for p, c in zip(t, chosen)}
            assert got[name] == want
            repaired += mended
    assert repaired > 0


def core_schema(spark, posts, users, files, edges, linked):
    return core.placed(posts, users, files, core.threads_of(edges, linked), "message LIKE '%approved%'").schema

"""Packing against a plain greedy pass, and the packet's shared budget."""

from collections import defaultdict

from pyspark.sql import functions as F

from weft.plans import context, packing

POSTS = "id string, root_id string, thread_id string, conversation_id string, user_id string, create_at long, update_at long, delete_at long, message string"
USERS = "id string, username string"


def rows():
    out = []
    for t in range(6):
        root = f"t{t}-00"
        for i in range(4 + 3 * t):
            text = "word " * (5 + (i * 7 + t) % 40) + (" PROJ-1" if (i + t) % 4 == 0 else "") + (" approved" if (i * t) % 5 == 3 else "")
            out.append((f"t{t}-{i:02d}", "" if i == 0 else root, root, "c0", "ann" if i % 2 else "bob", i, i, 9 if i == 2 else 0, text if i != 2 else ""))
    return out


def units(p):
    return len(p[4]) + 24 + len(p[8])


def plain_priorities(posts):
    live = sorted((p for p in posts if not p[7]), key=lambda p: (p[5], p[0]))
    out = {}
    for i, p in enumerate(live):
        near = lambda word, i=i: min((abs(i - j) for j, q in enumerate(live) if word in q[8]), default=99)
        m, q = near("PROJ-1"), near("approved")
        if p[0] == p[2]:
            level = 0
        elif m <= 2:
            level = 1 + m
        elif q <= 2:
            level = 4 + q
        else:
            level = 7 if len(live) - i <= 3 else 8
        out[p[0]] = level
    return live, out


def plain_choice(posts, budget):
    live, level = plain_priorities(posts)
    last, taken, left = max(level.values()), set(), budget

    def take(i):
        nonlocal left
        if i not in taken and units(live[i]) <= left:
            taken.add(i)
            left -= units(live[i])

    for i in sorted(range(len(live)), key=lambda i: (level[live[i][0]], i)):
        if level[live[i][0]] < last:
            take(i)
    had = sorted(taken)
    for a, b in zip(had, had[1:]):
        if 1 < b - a <= 3:
            for i in range(a + 1, b):
                take(i)
    for i in reversed(range(len(live))):
        take(i)
    return {p[0]: i in taken for i, p in enumerate(live)}


def frames(spark):
    return spark.createDataFrame(rows(), POSTS), spark.createDataFrame([("ann", "ann"), ("bob", "bob")], USERS)


def by_thread():
    out = defaultdict(list)
    for p in rows():
        out[p[2]].append(p)
    return out


MENTION, MATCH = "message LIKE '%PROJ-1%'", "message LIKE '%approved%'"


def test_threads_are_packed_as_a_plain_greedy_pass_does(spark):
    posts, users = frames(spark)
    got = {r["id"]: r["selected"] for r in packing.pack(posts, users, F.expr(MENTION), F.expr(MATCH), 600).collect()}
    want = {}
    for posts_ in by_thread().values():
        want |= plain_choice(posts_, 600)
    assert got == want and 0 < sum(got.values()) < len(got)


def test_timeline_marks_each_run_of_omitted_posts_once(spark):
    posts, users = frames(spark)
    packed = packing.pack(posts, users, F.expr(MENTION), F.expr(MATCH), 600).persist()
    got = sorted((r["thread_id"], r["pos"], r["shown"], r["posts"]) for r in packing.timeline(packed).collect())
    want, chosen = [], {r["id"]: r["selected"] for r in packed.collect()}
    for thread, posts_ in by_thread().items():
        live = [p for p in sorted(posts_, key=lambda p: p[5]) if not p[7]]
        i = 0
        while i < len(live):
            j = i + 1
            if not chosen[live[i][0]]:
                while j < len(live) and not chosen[live[j][0]]:
                    j += 1
            want.append((thread, i + 1, chosen[live[i][0]], j - i))
            i = j
    assert got == sorted(want)


def test_a_packet_shares_its_budget_and_gives_back_what_is_left(spark):
    posts, users = frames(spark)
    ranked = spark.createDataFrame([("t5-00", 1, True), ("t0-00", 2, True), ("t3-00", 3, True), ("t4-00", 4, False)], "thread_id string, rank long, selected boolean")
    budget = 2400
    got = context.packed(ranked, posts, users, F.expr(MENTION), F.expr(MATCH), budget).collect()
    assert {r["thread_id"] for r in got} == {"t5-00", "t0-00", "t3-00"}
    threads, order, share = by_thread(), ["t5-00", "t0-00", "t3-00"], 800
    choice = {t: plain_choice(threads[t], share) for t in order}
    size = {p[0]: units(p) for ps in threads.values() for p in ps}
    used = lambda c: sum(size[i] for i, s in c.items() if s)
    left = budget - sum(used(c) for c in choice.values())
    for t in order:
        if all(choice[t].values()):
            continue
        more = plain_choice(threads[t], used(choice[t]) + left)
        if used(more) > used(choice[t]):
            left -= used(more) - used(choice[t])
            choice[t] = more
    want = {i: s for c in choice.values() for i, s in c.items()}
    assert {r["id"]: r["selected"] for r in got} == want
    assert sum(r["units"] for r in got if r["selected"]) <= budget

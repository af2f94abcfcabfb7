"""The stored index: documents, postings, trigrams of tokens, entities, ticket edges, files, users and checkpoints under one manifest.

A search reads the buckets of its own tokens alone. An update takes changed posts by the
versioned rule; places (a row for each post: its thread, and the buckets in which its
postings, entities and edges lie) say which buckets are stale, so nothing else is read. All tables
change with one manifest: a writer that dies in between leaves the version before it.

Buckets follow the size of the input. A token's postings are dealt out within their bucket by
document, so that a frequent one is no single task's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import stems
from weft.functions import text as T
from weft.operators.retrieval import B, K1
from weft.operators.writes import entity_rows, tombstones, versioned_upsert
from weft.sources.bucketed import TableSet, bucket_number, buckets_for

DOCS = "id string, root_id string, thread_id string, conversation_id string, user_id string, create_at bigint, update_at bigint, delete_at bigint, message string, n_tokens int"
POSTINGS = "token string, id string, thread_id string, conversation_id string, create_at bigint, tf int, positions array<int>, doc_len int"
#: name: (schema, key, what deals a bucket out)
TABLES = {
    "docs": (DOCS, "thread_id", "id"),
    "postings": (POSTINGS, "token", "id"),
    "grams": ("gram string, token string", "gram", "token"),
    "entities": ("post_id string, kind string, normalized_value string, value string", "normalized_value", "post_id"),
    "edges": ("ticket_key string, id string, thread_id string, conversation_id string", "ticket_key", "id"),
    "places": ("id string, thread_id string, live boolean, n_tokens int, postings array<int>, entities array<int>, edges array<int>", "id", "id"),
    "files": ("id string, post_id string, name string, size bigint, delete_at bigint", "post_id", "id"),
    "users": ("id string, username string", "id", "id"),
    "checkpoints": ("conversation_id string, newest_post_id string, newest_post_at bigint, oldest_covered_at bigint, last_success_at bigint, error string", "conversation_id", "conversation_id"),
}
#: Derived from posts; each has the post's id in the column named.
DERIVED = {"postings": "id", "entities": "post_id", "edges": "id"}
_NAMES = {name: [c.split()[0] for c in ddl.split(", ")] for name, (ddl, _, _) in TABLES.items()}

STEM, START = "s:", "^"


def posting_rows(docs: DataFrame, concepts: dict[str, list[str]] | None = None) -> DataFrame:
    """Postings of live posts with a text: tokens, stems of Cyrillic tokens (under "s:"), and the tokens of concepts that a text names."""
    live = docs.where((F.col("delete_at") == 0) & (F.col("n_tokens") > 0)).select("id", "thread_id", "conversation_id", "create_at", F.col("n_tokens").alias("doc_len"), "message")
    base = ["id", "thread_id", "conversation_id", "create_at", "doc_len"]
    toks = live.select(*base, F.posexplode(T.tokens(F.col("message"))).alias("pos", "token"))
    cyrillic = live.where(F.col("message").rlike("[а-яёА-ЯЁ]")).select(*base, F.posexplode(stems.stems(F.col("message"))).alias("pos", "token")).where(F.col("token").rlike("^[а-яё]+$"))
    toks = toks.unionByName(cyrillic.withColumn("token", F.concat(F.lit(STEM), F.translate("token", "ё", "е"))))
    if concepts:
        toks = toks.unionByName(live.select(*base, F.lit(0).alias("pos"), F.explode(stems.concept_tokens(F.col("message"), concepts)).alias("token")))
    return toks.groupBy("token", "id", "thread_id", "conversation_id", "create_at", "doc_len").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions")).select(*_NAMES["postings"])


def gram_rows(tokens: DataFrame) -> DataFrame:
    """(gram, token) of plain tokens: their trigrams, and their first four letters behind "^"."""
    plain = tokens.where(~F.col("token").startswith(STEM) & (F.length("token") >= 3)).select("token").distinct()
    start = F.when(F.length("token") >= 4, F.array(F.concat(F.lit(START), F.left("token", F.lit(4))))).otherwise(F.array().cast("array<string>"))
    return plain.select(F.explode(F.concat(T.trigrams(F.col("token")), start)).alias("gram"), "token")


def edge_rows(docs: DataFrame) -> DataFrame:
    """(ticket_key, id, thread_id, conversation_id): tickets that live posts name."""
    return docs.where("delete_at = 0").select(F.explode(F.array_distinct(T.ticket_keys(F.col("message")))).alias("ticket_key"), "id", "thread_id", "conversation_id")


class PostIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, concepts: dict[str, list[str]] | None = None):
        """buckets: the fewest of each table that is built; otherwise they follow the input's size alone."""
        self.spark, self.concepts, self.least = spark, concepts, buckets
        self.set = TableSet(spark, path, TABLES)

    @property
    def built(self) -> bool:
        return self.set.manifest()["version"] > 0

    def table(self, name: str) -> DataFrame:
        return self.set.rows(name)

    def meta(self) -> dict:
        return self.set.manifest()["meta"]

    def _rows(self, posts: DataFrame) -> DataFrame:
        return tombstones(posts).withColumn("n_tokens", F.size(T.tokens(F.col("message")))).select(*_NAMES["docs"])

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.set.tables[name][0])

    def _derived(self, docs: DataFrame, files: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
        known = users.select(F.col("id").alias("user_id"), "username")
        named = docs.join(known, "user_id", "left").withColumn("user_id", F.coalesce("username", "user_id"))
        return {"postings": posting_rows(docs, self.concepts), "entities": entity_rows(named, files), "edges": edge_rows(docs)}

    def _places(self, docs: DataFrame, derived: dict[str, DataFrame], n: dict[str, int]) -> DataFrame:
        live = F.col("delete_at") == 0
        out = docs.select("id", "thread_id", live.alias("live"), F.when(live, F.col("n_tokens")).otherwise(0).alias("n_tokens"))
        for name, key in DERIVED.items():
            at = self.set.bucket(F.col(TABLES[name][1]), n[name])
            out = out.join(derived[name].select(F.col(key).alias("id"), at.alias("b")).groupBy("id").agg(F.array_sort(F.collect_set("b")).alias(name)), "id", "left")
        return out.withColumns({name: F.coalesce(name, F.array().cast("array<int>")) for name in DERIVED})

    def build(self, posts: DataFrame, files: DataFrame | None = None, users: DataFrame | None = None) -> PostIndex:
        """Everything anew, whatever was there, in one version."""
        old = self.set.manifest()
        n = dict.fromkeys(TABLES, buckets_for(posts, self.least or 1))
        staged = {"docs": self.set.stage("docs", self._rows(posts), n["docs"])}
        docs = self.set.files("docs", staged["docs"])
        held = {"files": files, "users": users}
        for name, given in held.items():
            staged[name] = self.set.stage(name, self._empty(name) if given is None else given, n[name])
        derived = self._derived(docs, self.set.files("files", staged["files"]), self.set.files("users", staged["users"]))
        for name in DERIVED:
            staged[name] = self.set.stage(name, derived[name], n[name])
        written = {name: self.set.files(name, staged[name]) for name in DERIVED}
        staged["places"] = self.set.stage("places", self._places(docs, written, n), n["places"])
        staged["grams"] = self.set.stage("grams", gram_rows(written["postings"]), n["grams"])
        staged["checkpoints"] = self.set.stage("checkpoints", self._empty("checkpoints"), n["checkpoints"])
        # Whatever buckets the version before had are replaced.
        self.set.publish(old, {name: (n[name], f, old["tables"].get(name, {"folders": {}})["folders"]) for name, f in staged.items()}, self._totals(self.set.files("places", staged["places"])))
        return self

    def _totals(self, places: DataFrame) -> dict:
        n, length = places.where("live").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        return {"n_docs": n, "total_len": length}

    def update(self, posts: DataFrame | None = None, files: DataFrame | None = None, users: DataFrame | None = None, checkpoints: DataFrame | None = None, meta: dict | None = None) -> PostIndex:
        """Changed posts that are newer than what is stored replace it (on equal versions too), also where they name another thread;
        files and users replace those of the same id. What follows from them is made anew for the posts they touch. One version holds it all, and what meta says beside the totals.

        Posts are found by their places; those of changed users by a scan of the documents' authors.
        """
        s, old = self.set, self.set.manifest()
        n = {name: t["n"] for name, t in old["tables"].items()}
        rows = lambda name, at=None: s.rows(name, at, old)
        changes: dict[str, tuple[int, dict[str, str], list[int]]] = {}
        # At most as many rows as there are buckets reach the driver.
        numbers = lambda df: sorted(r[0] for r in df.distinct().collect())
        hit = lambda name, df: numbers(df.select(s.bucket(F.col(TABLES[name][1]), n[name])))

        def replace(name: str, fresh: DataFrame, touched: list[int], stale: DataFrame, key: str) -> DataFrame:
            """Stages the touched buckets with fresh rows in place of those whose key is stale."""
            now = rows(name, touched).join(stale.select(F.col(stale.columns[0]).alias(key)).distinct(), key, "left_anti").unionByName(fresh.select(*_NAMES[name]))
            changes[name] = (n[name], s.stage(name, now, n[name]), touched)
            return s.files(name, changes[name][1])

        current = {"files": rows("files"), "users": rows("users")}
        touched_ids = []
        if files is not None:
            fresh = files.groupBy("id").agg(F.max_by(F.struct(*_NAMES["files"][1:]), F.col("delete_at")).alias("r")).select("id", "r.*")
            # A file that hangs on another post now leaves the old one, which only a scan of the files finds.
            before = rows("files").join(fresh.select("id"), "id", "left_semi").select("post_id", "id")
            at = sorted({*hit("files", fresh), *hit("files", before)})
            replace("files", fresh, at, fresh.select("id"), "id")
            touched_ids += [fresh.select(F.col("post_id").alias("id")), before.select(F.col("post_id").alias("id"))]
            current["files"] = s.files("files", self._now(old, changes, "files"))
        if users is not None:
            fresh = users.groupBy("id").agg(F.max("username").alias("username"))
            replace("users", fresh, hit("users", fresh), fresh.select("id"), "id")
            touched_ids.append(rows("docs").select("id", "user_id").join(fresh.select(F.col("id").alias("user_id")), "user_id", "left_semi").select("id"))
            current["users"] = s.files("users", self._now(old, changes, "users"))
        if checkpoints is not None:
            replace("checkpoints", checkpoints, hit("checkpoints", checkpoints), checkpoints.select("conversation_id"), "conversation_id")
        given = self._empty("docs") if posts is None else self._rows(posts)
        meta = dict(meta or {})
        if posts is not None:
            touched_ids.append(given.select("id"))
        ids = reduce(DataFrame.unionByName, touched_ids).distinct() if touched_ids else None
        at = hit("places", ids) if ids is not None else []
        if at:
            known = rows("places", at).join(ids, "id", "left_semi")
            stored = rows("docs", hit("docs", known)).join(ids, "id", "left_semi")
            newest = versioned_upsert(stored.withColumn("arrival", F.lit(0)).unionByName(given.withColumn("arrival", F.lit(1)))).select(*_NAMES["docs"])
            # Written once beside the tables; what follows reads it several times.
            fresh = s.files("docs", s.stage("docs", newest, n["docs"]))
            places = s.files("places", s.stage("places", known, n["places"]))
            replace("docs", fresh, sorted({*hit("docs", places), *hit("docs", fresh)}), fresh.select("id"), "id")
            own_files = current["files"].join(fresh.select(F.col("id").alias("post_id")), "post_id", "left_semi")
            derived = self._derived(fresh, own_files, current["users"])
            stale_tokens = None
            for name, key in DERIVED.items():
                made = s.files(name, s.stage(name, derived[name], n[name]))
                old_at = numbers(places.select(F.explode(name)))
                if name == "postings":
                    stale_tokens = rows(name, old_at).join(places.select("id"), "id", "left_semi").select("token").unionByName(made.select("token")).distinct()
                    stale_tokens = stale_tokens.where(~F.col("token").startswith(STEM))
                now = replace(name, made, sorted({*old_at, *hit(name, made)}), fresh.select("id"), key)
                if name == "postings":
                    alive = now.select("token").distinct().join(stale_tokens, "token", "left_semi")
                    replace("grams", gram_rows(alive), hit("grams", gram_rows(stale_tokens)), stale_tokens, "token")
                derived[name] = made
            made = self._places(fresh, derived, n)
            now = replace("places", made, at, fresh.select("id"), "id")
            gone, come = self._totals(places), self._totals(now.join(fresh.select("id"), "id", "left_semi"))
            meta |= {k: old["meta"][k] - gone[k] + come[k] for k in gone}
        if changes or meta:
            s.publish(old, changes, meta)
        return self

    @staticmethod
    def _now(old: dict, changes: dict, name: str) -> dict[str, str]:
        _, staged, touched = changes[name]
        gone = {str(b) for b in touched}
        return {b: f for b, f in old["tables"][name]["folders"].items() if b not in gone} | staged

    def _lookup(self, name: str, values: list[str]) -> DataFrame:
        manifest = self.set.manifest()
        n = manifest["tables"][name]["n"]
        return self.set.rows(name, {bucket_number(v, n) for v in values}, manifest).where(F.col(TABLES[name][1]).isin(values))

    def postings(self, tokens: list[str]) -> DataFrame:
        """Postings of these tokens, from their buckets alone."""
        return self._lookup("postings", sorted({t.lower() for t in tokens}))

    def postings_of(self, tokens: DataFrame) -> DataFrame:
        """Postings of the tokens of a frame (token), from their buckets alone; the numbers of the buckets reach the driver."""
        manifest = self.set.manifest()
        at = tokens.select(self.set.bucket(F.col("token"), manifest["tables"]["postings"]["n"])).distinct().collect()
        return self.set.rows("postings", [r[0] for r in at], manifest)

    def grams(self, values: list[str]) -> DataFrame:
        return self._lookup("grams", values)

    def threads(self, ids: list[str]) -> DataFrame:
        """Documents of these threads, from their buckets alone."""
        return self._lookup("docs", ids)

    def edges(self, ticket: str) -> DataFrame:
        return self._lookup("edges", [ticket.upper()])

    def entities(self, kind: str, value: str) -> DataFrame:
        return self._lookup("entities", [value.lower()]).where(F.col("kind") == kind)

    def prefix(self, start: str) -> DataFrame:
        """Postings of tokens that begin so, with four letters at least."""
        start = start.lower()
        tokens = self.grams([START + start[:4]]).where(F.col("token").startswith(start)).select("token")
        return self.postings_of(tokens).join(tokens, "token", "left_semi")

    def scored(self, tokens: list[str]) -> DataFrame:
        """(id, thread_id, conversation_id, create_at, token, score): the part of each token in a post's BM25, negative is better."""
        hits = self.postings(tokens)
        df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        return hits.join(df, "token").select("id", "thread_id", "conversation_id", "create_at", "token", (-self.bm25("df", "tf", "doc_len")).alias("score"))

    def bm25(self, df: str, tf: str, length: str) -> Column:
        meta = self.meta()
        raw = F.log((F.lit(meta["n_docs"]) - F.col(df) + 0.5) / (F.col(df) + 0.5))
        average = meta["total_len"] / max(meta["n_docs"], 1)
        return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw) * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.lit(average)))

    def phrase(self, words: list[str]) -> DataFrame:
        """(id, thread_id, n): how often the words stand one behind the other."""
        words = [w.lower() for w in words]
        places = self.spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token string, place int")
        starts = self.postings(words).join(places, "token").groupBy("id", "thread_id").agg(F.count(F.lit(1)).alias("k"), F.collect_list(F.transform("positions", lambda p: p - F.col("place"))).alias("starts"))
        return starts.where(F.col("k") == len(words)).select("id", "thread_id", F.size(common("starts")).cast("long").alias("n")).where("n > 0")


def common(lists: str) -> Column:
    """What all arrays of a non-empty array of arrays hold."""
    return F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(1))), F.get(lists, F.lit(0)), F.array_intersect)

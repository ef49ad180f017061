"""Accounts, their aliases and merges: a forest of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.lineage import cut

#: Doublings after which a path is sure to be a cycle: longer than any forest of 2^32 nodes needs.
MAX_ROUNDS = 33


def canonical_accounts(merges: DataFrame, src: str = "from_key", dst: str = "into_key") -> DataFrame:
    """``node, root`` of every account in an unrevoked merge, by pointer doubling: as many rounds as
    the logarithm of the longest chain. A cycle raises."""
    live = merges.filter(F.col("revoked_at").isNull()) if "revoked_at" in merges.columns else merges
    up = cut(live.select(F.col(src).alias("node"), F.col(dst).alias("root")), "merges")
    for _ in range(MAX_ROUNDS):
        above = up.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        up = cut(up.join(above, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "merges")
        if up.filter("_moved").limit(1).count() == 0:
            roots = up.select(F.col("root").alias("node"), "root").distinct()
            return up.select("node", "root").unionByName(roots)
        up = up.drop("_moved")
    raise ValueError("the merges hold a cycle")


def alias_conflicts(aliases: DataFrame, roots: DataFrame) -> DataFrame:
    """Aliases whose live reported rows belong to more than one canonical account."""
    live = aliases.filter("revoked_at IS NULL AND asserted_by = 'reported'")
    known = live.join(roots.select(F.col("node").alias("account_key"), "root"), "account_key", "left").withColumn("account", F.coalesce("root", "account_key"))
    return known.groupBy("alias_kind", "alias_hash").agg(F.sort_array(F.collect_set("account")).alias("accounts")).filter(F.size("accounts") > 1)


def assert_aliases(sightings: DataFrame, registry: DataFrame, roots: DataFrame, secret: str) -> tuple[DataFrame, DataFrame]:
    """The registry with the sightings (alias_kind, alias_hash, asserted_by, seen_at) asserted, and the
    sightings refused because their alias belongs to several accounts.

    An alias keeps its own row's account, else takes the single canonical account of its reported rows,
    else a new key is minted from the alias, so that recomputation mints the same one. A sighting
    confirms its row and clears its tombstone.
    """
    alias = ["alias_kind", "alias_hash"]
    seen = sightings.groupBy(*alias, "asserted_by").agg(F.max("seen_at").alias("seen_at"))
    own = registry.groupBy(*alias, "asserted_by").agg(F.min("account_key").alias("_own"), F.countDistinct("account_key").alias("_n"))
    live = registry.filter("revoked_at IS NULL AND asserted_by = 'reported'").join(roots.select(F.col("node").alias("account_key"), "root"), "account_key", "left")
    reported = live.withColumn("_c", F.coalesce("root", "account_key")).groupBy(*alias).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    joined = seen.join(own, [*alias, "asserted_by"], "left").join(reported, alias, "left")
    clash = F.coalesce((F.coalesce("_n", F.lit(0)) != 1) & (F.col("_lo") != F.col("_hi")), F.lit(False))
    minted = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(secret), *alias), 256), 1, 32)
    fresh = joined.filter(~clash).select(*alias, "asserted_by", F.coalesce(F.when(F.col("_n") == 1, F.col("_own")), F.col("_lo"), minted).alias("account_key"), F.col("seen_at").alias("last_confirmed"), F.lit(None).cast("long").alias("revoked_at"))
    old = registry.select(*alias, "asserted_by", "account_key", "last_confirmed", "revoked_at").withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    out = old.groupBy(*alias, "asserted_by", "account_key").agg(F.max("last_confirmed").alias("last_confirmed"), F.max_by("revoked_at", "_new").alias("revoked_at"))
    return out, joined.filter(clash).select(*alias, "asserted_by")


#: What a value begins with that names an alias in place of an account: ``alias:<provider>:<kind>:<hash>``. A fixed value.
ALIAS_PREFIX = "alias:"


def alias_value(provider: Column, kind: Column, digest: Column) -> Column:
    """An account as a source can name it: by an alias. Null without any of the parts."""
    return F.concat(F.lit(ALIAS_PREFIX), provider, F.lit(":"), kind, F.lit(":"), digest)


def resolve_alias_values(evidence: DataFrame, registry: DataFrame, roots: DataFrame, secret: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Account evidence with the accounts that its alias values mean, the registry with these aliases asserted, and
    the evidence that was refused because its alias belongs to several accounts.

    A value ``alias:<provider>:<kind>:<hash>`` (the hash may hold colons) becomes the account of its alias, whose kind in the
    registry is ``provider:kind``; an alias that is not known makes a new account. Other values, other dimensions and
    values with fewer parts stay as they are."""
    part = F.split("value", ":", 4)
    is_alias = (F.col("dimension") == "account") & F.col("value").startswith(ALIAS_PREFIX) & (F.size(part) == 4)
    told = evidence.filter(is_alias).withColumn("alias_kind", F.concat_ws(":", part[1], part[2])).withColumn("alias_hash", part[3])
    seen = told.select("alias_kind", "alias_hash", F.lit("reported").alias("asserted_by"), F.col("last_confirmed_at").alias("seen_at"))
    out, refused = assert_aliases(seen, registry, roots, secret)
    known = out.filter("asserted_by = 'reported' AND revoked_at IS NULL").join(roots.select(F.col("node").alias("account_key"), "root"), "account_key", "left")
    account = known.groupBy("alias_kind", "alias_hash").agg(F.min(F.coalesce("root", "account_key")).alias("_account"))
    bad = refused.select("alias_kind", "alias_hash").distinct()
    good = told.join(bad, ["alias_kind", "alias_hash"], "left_anti").join(account, ["alias_kind", "alias_hash"])
    resolved = good.withColumn("value", F.col("_account")).select(evidence.columns)
    return evidence.filter(~F.coalesce(is_alias, F.lit(False))).unionByName(resolved), out, told.join(bad, ["alias_kind", "alias_hash"], "left_semi").select(evidence.columns)


def least_connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` of every node of an edge but the roots: the least node that it is connected with. In
    each round every node hands its least neighbour to its larger ones, then to its smaller ones, until
    all point at their root; rounds grow with the logarithm of the graph. Nulls and loops are ignored."""
    live, before = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("x <> y").distinct(), None
    while True:
        live = cut(live, "links")
        now = live.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            return live.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before = now
        both = live.unionByName(live.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        tops = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(tops, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y")
        live = small.unionByName(tops.select("x", F.col("m").alias("y"))).distinct()


def merges_of_links(links: DataFrame, roots: DataFrame, revoked: DataFrame) -> DataFrame:
    """Merges (from_key, into_key) that co-reported aliases call for, one for each account at most: all
    canonical accounts that are connected go into the least of them. A link of two accounts whose merge
    was revoked connects nothing, and no such merge is made anew."""
    known = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}"))
    pairs = links.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
    refused = revoked.select("from_key", "into_key").distinct()
    wanted = pairs.filter("x <> y").select(F.greatest("x", "y").alias("from_key"), F.least("x", "y").alias("into_key")).distinct().join(refused, ["from_key", "into_key"], "left_anti")
    merged = least_connected(wanted, "from_key", "into_key").select(F.col("node").alias("from_key"), F.col("root").alias("into_key"))
    return merged.join(refused, ["from_key", "into_key"], "left_anti")


def merge_violations(merges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Live merges that break a rule: ends that are equal or unknown, several outgoing merges of one
    account, evidence merges into the larger key."""
    live = merges.filter("revoked_at IS NULL")
    keys = accounts.select(F.col("account_key"))
    equal = live.filter("from_key = into_key").select("from_key", "into_key", F.lit("equal ends").alias("problem"))
    unknown = live.join(keys, live.from_key == keys.account_key, "left_anti").unionByName(live.join(keys, live.into_key == keys.account_key, "left_anti")).select("from_key", "into_key", F.lit("unknown account").alias("problem")).distinct()
    many = live.groupBy("from_key").agg(F.count("*").alias("n"), F.min("into_key").alias("into_key")).filter("n > 1").select("from_key", "into_key", F.lit("several outgoing merges").alias("problem"))
    upward = live.filter("evidence = 'evidence' AND into_key > from_key").select("from_key", "into_key", F.lit("evidence merges into the larger key").alias("problem"))
    return equal.unionByName(unknown).unionByName(many).unionByName(upward)


def unmerge(merges: DataFrame, merge_ids: list[int], now_ms: int) -> DataFrame:
    """Revoke merges; aliases never move, and roots are computed anew from what stays."""
    return merges.withColumn("revoked_at", F.when(F.col("merge_id").isin(merge_ids) & F.col("revoked_at").isNull(), F.lit(now_ms)).otherwise(F.col("revoked_at")))


def merge_candidates(aliases: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of canonical accounts that share an alias, whoever asserted it: between the least of an
    alias and each other one, so an alias of many accounts gives as many rows and not their pairs."""
    known = aliases.filter("revoked_at IS NULL").join(roots.select(F.col("node").alias("account_key"), "root"), "account_key", "left").withColumn("account", F.coalesce("root", "account_key"))
    first = known.groupBy("alias_kind", "alias_hash").agg(F.min("account").alias("into_key"))
    return known.join(first, ["alias_kind", "alias_hash"]).filter("account <> into_key").groupBy(F.col("account").alias("from_key"), "into_key").agg(F.countDistinct("alias_kind", "alias_hash").alias("shared_aliases"))

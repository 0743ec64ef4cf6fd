"""Who may see and change what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("none", "view", "edit")


def access_levels(users: DataFrame, items: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, kind, item_id, level): what a person may do with items of the own organization, without writing out all pairs.

    One row per person and kind of item (item_id null) holds the level of all its items, and one per grant on an item
    that differs from it. An organization's admin edits everything; else a grant replaces the organization-wide level, up or
    down. Platform admins edit everything (levels_of sees to that) and people reach nothing of other organizations: neither is written out.
    users: id, is_admin, org_id, org_role, org_access; items: kind, id, org_id; grants: user_id, kind, item_id, level.
    """
    people = users.where("not is_admin").select(F.col("id").alias("user_id"), "org_id", F.when(F.col("org_role") == "admin", "edit").otherwise(F.col("org_access")).alias("_default"), "org_role")
    kinds = people.join(items.select("kind", "org_id").distinct(), "org_id").select("user_id", "kind", F.lit(None).cast("string").alias("item_id"), F.col("_default").alias("level"))
    own = grants.where(F.col("level").isin(*LEVELS)).join(people.where("org_role is distinct from 'admin'"), "user_id")
    own = own.join(items.select("kind", F.col("id").alias("item_id"), "org_id"), ["kind", "item_id", "org_id"], "left_semi")
    return kinds.unionByName(own.where("level is distinct from _default").select("user_id", "kind", "item_id", "level"))


def levels_of(rows: DataFrame, levels: DataFrame, users: DataFrame, items: DataFrame, kind: str, item: str, user: str) -> DataFrame:
    """rows with the level of their user on their item of a kind: `edit` for platform admins in any organization; else the
    exception, else the person's default; none outside the own organization, and on items that don't exist.
    """
    admins = users.where("is_admin").select(F.col("id").alias(user), F.lit(True).alias("_all")).distinct()
    mine = levels.where(F.col("kind") == kind)
    default = mine.where(F.col("item_id").isNull()).join(users.select(F.col("id").alias("user_id"), F.col("org_id").alias("_o")), "user_id").select(F.col("user_id").alias(user), "_o", F.col("level").alias("_default"))
    grant = mine.where(F.col("item_id").isNotNull()).select(F.col("item_id").alias(item), F.col("user_id").alias(user), F.col("level").alias("_own"))
    there = items.where(F.col("kind") == kind).select(F.col("id").alias(item), F.col("org_id").alias("_o"), F.lit(True).alias("_there"))
    out = rows.join(there, item, "left").join(default, [user, "_o"], "left").join(grant, [item, user], "left").join(admins, user, "left")
    return out.withColumn("level", F.when(F.col("_all") & F.col("_there"), "edit").otherwise(F.coalesce("_own", "_default", F.lit("none")))).drop("_o", "_there", "_default", "_own", "_all")


def visible(rows: DataFrame, levels: DataFrame, users: DataFrame, items: DataFrame, kind: str, item: str, user: str) -> DataFrame:
    """Rows (item, user columns) that the user may see."""
    return levels_of(rows, levels, users, items, kind, item, user).where("level <> 'none'").select(*rows.columns)


def org_summary(orgs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Members, admins and items of each kind by organization; what has none counts 0."""
    people = users.groupBy("org_id").agg(F.count("*").alias("members"), F.count_if(F.col("org_role") == "admin").alias("admins"))
    kinds = items.groupBy("org_id").pivot("kind", ["agent", "table", "app"]).count()
    out = orgs.join(people, orgs["id"] == people["org_id"], "left").drop("org_id").join(kinds, orgs["id"] == kinds["org_id"], "left")
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n)
    return out.select(orgs["id"], orgs["name"], zero("members", "members"), zero("admins", "admins"), zero("agent", "bots"), zero("table", "tables"), zero("app", "apps"))


def child_counts(parent: DataFrame, child: DataFrame, key: str, parent_key: str, to: str) -> DataFrame:
    """parent with the number of its children."""
    n = child.groupBy(F.col(parent_key).alias("_p")).agg(F.count("*").alias(to))
    return parent.join(n, parent[key] == n["_p"], "left").drop("_p").withColumn(to, F.coalesce(to, F.lit(0)))


def duplicate_claims(claims: DataFrame, phone: str = "phone", agent: str = "agent_id") -> DataFrame:
    """Phones that more than one agent claims, with the bots in order."""
    out = claims.select(phone, agent).distinct().groupBy(phone).agg(F.count("*").alias("claims"), F.sort_array(F.collect_list(agent)).alias("bots"))
    return out.where("claims > 1")

"""Model usage: costs, charges, monthly counters, reports, balances, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bins import bin_of

#: USD a million tokens (input, output) where the catalog has no price; output tokens that are assumed, and allowed at most.
FALLBACK_PRICE, DEFAULT_OUTPUT, MOST_OUTPUT = (10.0, 40.0), 4096, 128_000
CHARGE = "decimal(38,12)"
#: Sources of calls that strangers make; the names are the table's own.
PUBLIC_SOURCES = ("bots", "app")


def month_of(at: Column) -> Column:
    """First day of the month of a timestamp without zone (UTC wall clock)."""
    return F.trunc(at, "month")


def usage_costs(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Whole non-negative tokens, and the reported cost or tokens x catalog price (null where there are no tokens).

    calls: model, input_tokens, output_tokens, cost (null where not reported);
    catalog: model, input_per_m, output_per_m. The catalog is small by nature and joined as adaptive execution sees fit.
    """
    whole = lambda c: F.coalesce(F.floor(F.greatest(F.col(c).cast("double"), F.lit(0.0))), F.lit(0)).cast("long")
    priced = F.col("input_per_m").isNotNull() & F.col("output_per_m").isNotNull()
    price = lambda c, i: F.when(priced, F.col(c)).otherwise(FALLBACK_PRICE[i])
    out = calls.withColumns({"input_tokens": whole("input_tokens"), "output_tokens": whole("output_tokens")}).join(catalog, "model", "left")
    counted = F.when(
        (F.col("input_tokens") > 0) | (F.col("output_tokens") > 0),
        F.round((F.col("input_tokens") * price("input_per_m", 0) + F.col("output_tokens") * price("output_per_m", 1)) / 1e6, 6),
    )
    return out.withColumn("cost_usd", F.coalesce(F.col("cost"), counted)).drop("input_per_m", "output_per_m")


def charge_usage(usage: DataFrame, billing: DataFrame) -> DataFrame:
    """charged_usd = cost x (1 + markup / 100), unrounded; no billing row: no markup."""
    markup = F.coalesce(F.col("markup_pct"), F.lit(0)).cast("decimal(9,4)")
    return usage.join(billing.select("org_id", "markup_pct"), "org_id", "left").withColumn("charged_usd", (F.col("cost_usd") * (F.lit(100).cast("decimal(9,4)") + markup) * F.lit("0.01").cast("decimal(3,2)")).cast(CHARGE)).drop("markup_pct")


def spend_scopes(usage: DataFrame, public_sources: tuple[str, ...] = PUBLIC_SOURCES) -> DataFrame:
    """One row per call and scope that it moves: (scope, key, amount) beside the call's columns.

    platform: its cost. org-public: the cost of strangers' calls (no user, from a public source). item, member: what is charged.
    """
    public = F.col("user_id").isNull() & F.col("source").isin(*public_sources)
    row = lambda scope, key, amount: F.struct(F.lit(scope).alias("scope"), key.alias("key"), F.col(amount).cast(CHARGE).alias("amount"))
    scopes = F.array(
        row("platform", F.lit(""), "cost_usd"),
        F.when(F.col("org_id").isNotNull() & public, row("org-public", F.col("org_id"), "cost_usd")),
        F.when(F.col("org_id").isNotNull() & F.col("item_id").isNotNull(), row("item", F.concat_ws(":", "org_id", "item_type", "item_id"), "charged_usd")),
        F.when(F.col("org_id").isNotNull() & F.col("user_id").isNotNull(), row("member", F.concat_ws(":", "org_id", "user_id"), "charged_usd")),
    )
    return usage.withColumn("_s", F.explode(F.array_compact(scopes))).select("*", "_s.*").drop("_s")


def month_spend(usage: DataFrame) -> DataFrame:
    """(scope, key, month, spent_usd) of charged usage. One aggregation; the platform's single key is summed map-side."""
    return spend_scopes(usage).groupBy("scope", "key", month_of(F.col("at")).alias("month")).agg(F.sum("amount").alias("spent_usd"))


def last_topups(topups: DataFrame) -> DataFrame:
    """The last positive top-up of every organization (newest, then largest id)."""
    return topups.where("amount_usd > 0").groupBy("org_id").agg(F.max_by("amount_usd", F.struct("at", "id")).alias("last_topup"))


def balance_health(billing: DataFrame, topups: DataFrame, ceiling: float = 50.0, public_pct: float = 50.0) -> DataFrame:
    """low: under a fifth of the last positive top-up; stopped: nothing left; what the balance still buys; the effective public cap."""
    balance = F.round(F.col("balance_usd").cast("double"), 4)
    share = F.lit(round(ceiling * public_pct / 100, 4) if public_pct < 100 and ceiling > 0 else None).cast("double")
    return billing.join(last_topups(topups), "org_id", "left").select(
        "org_id",
        balance.alias("balance"),
        F.col("last_topup").cast("double").alias("last_topup"),
        (balance.isNotNull() & (balance > 0) & F.coalesce(balance < F.col("last_topup").cast("double") * 0.2, F.lit(False))).alias("low"),
        F.coalesce(balance <= 0, F.lit(False)).alias("stopped"),
        F.round(F.greatest(balance, F.when(balance.isNotNull(), 0.0)) / (1 + F.coalesce(F.col("markup_pct"), F.lit(0)).cast("double") / 100), 4).alias("can_still_cost_usd"),
        F.coalesce(F.col("public_monthly_cap_usd").cast("double"), share).alias("public_cap_usd"),
    )


def platform_report(usage: DataFrame, orgs: DataFrame, ceiling: float = 50.0) -> DataFrame:
    """One row per organization: calls, tokens, cost, charged, profit on charged calls, share of the ceiling."""
    used = usage.groupBy("org_id").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input"),
        F.sum("output_tokens").alias("output"),
        F.sum("cost_usd").alias("usd"),
        F.sum("charged_usd").alias("charged"),
        F.sum(F.when(F.col("charged_usd").isNotNull(), F.col("cost_usd"))).alias("charged_cost"),
    )
    money = lambda c: F.coalesce(F.round(c, 4).cast("double"), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = orgs.join(used, orgs["id"] == used["org_id"], "left").select(
        "id", "name", zero("calls"), zero("input"), zero("output"), money(F.col("usd")).alias("usd"), money(F.col("charged")).alias("charged"),
        money(F.coalesce(F.col("charged"), F.lit(0)) - F.coalesce(F.col("charged_cost"), F.lit(0))).alias("profit"),
    )
    return out.withColumn("share", F.col("usd") / F.lit(ceiling) if ceiling > 0 else F.lit(None).cast("double"))


def chargeable_items(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """(kind, org_id, id, name) of everything that can be charged, from (kind, rows with org_id, id, name)."""
    out = None
    for kind, df in kinds:
        rows = df.select(F.lit(kind).alias("kind"), "org_id", "id", F.coalesce("name", F.lit("")).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def org_report(usage: DataFrame, items: DataFrame, limits: DataFrame) -> DataFrame:
    """A line per item, used or not, and one per source for calls tied to no item; with limits.

    An item that was used but doesn't exist is "(deleted)".
    """
    tied = F.col("item_id").isNotNull()
    used = usage.groupBy("org_id", F.when(tied, F.col("item_type")).otherwise("platform").alias("kind"), F.when(tied, F.col("item_id")).otherwise(F.col("source")).alias("id")).agg(
        F.count("*").alias("calls"), F.sum("charged_usd").alias("charged")
    )
    lines = items.withColumn("_there", F.lit(True)).join(used, ["org_id", "kind", "id"], "full")
    name = F.when(F.col("_there").isNotNull(), F.when(F.col("name") == "", "(unnamed)").otherwise(F.col("name"))).when(F.col("kind") == "platform", F.col("id")).otherwise("(deleted)")
    capped = lines.join(limits.select("org_id", "kind", F.col("target_id").alias("id"), F.col("monthly_usd").cast("double").alias("limit_usd")), ["org_id", "kind", "id"], "left")
    return capped.select(
        "org_id", "kind", "id", name.alias("name"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce(F.round("charged", 4).cast("double"), F.lit(0.0)).alias("charged"),
        F.when(F.col("kind") != "platform", F.col("limit_usd")).alias("limit_usd"),
    )


def member_report(usage: DataFrame, users: DataFrame, limits: DataFrame) -> DataFrame:
    """Every member with calls, charged and limit."""
    used = usage.where(F.col("user_id").isNotNull()).groupBy("org_id", "user_id").agg(F.count("*").alias("calls"), F.sum("charged_usd").alias("charged"))
    caps = limits.where("kind = 'member'").select("org_id", F.col("target_id").alias("user_id"), F.col("monthly_usd").cast("double").alias("limit_usd"))
    return users.select("org_id", F.col("id").alias("user_id"), "username").join(used, ["org_id", "user_id"], "left").join(caps, ["org_id", "user_id"], "left").select(
        "org_id", "user_id", "username", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce(F.round("charged", 4).cast("double"), F.lit(0.0)).alias("charged"), "limit_usd"
    )


def ceiling_outlook(health: DataFrame, spent: DataFrame, ceiling: float = 50.0) -> DataFrame:
    """What the balances can still buy against what is left under the ceiling. spent: one row, spent_usd."""
    promised = health.agg(F.round(F.sum("can_still_cost_usd"), 4).alias("promised_usd"))
    total = spent.agg(F.round(F.sum("spent_usd"), 4).cast("double").alias("spent"))
    left = F.round(F.greatest(F.lit(ceiling) - F.coalesce(F.col("spent"), F.lit(0.0)), F.lit(0.0)), 4)
    return promised.crossJoin(F.broadcast(total)).select(F.coalesce("promised_usd", F.lit(0.0)).alias("promised_usd"), left.alias("left_usd"), (F.coalesce("promised_usd", F.lit(0.0)) > left).alias("over"))  # one row each


def balance_ledger(topups: DataFrame, usage: DataFrame) -> DataFrame:
    """Top-ups and charges of every organization in time order, with the balance after each.

    No balance (null) before the first top-up, which starts from 0, and after a removal
    (a top-up row with removal = true). Charges come off only while there is a
    balance; a null charge takes nothing. At one instant top-ups come first. Windows run inside one organization's
    day, and over day totals: no organization is one task.
    """
    rows = topups.select("org_id", "at", F.lit(0).alias("step"), "id", F.when(~F.col("removal"), F.col("amount_usd").cast(CHARGE)).alias("amount"), F.col("removal")).unionByName(
        usage.select("org_id", "at", F.lit(1).alias("step"), "id", (-F.coalesce("charged_usd", F.lit(0).cast(CHARGE))).cast(CHARGE).alias("amount"), F.lit(False).alias("removal"))
    )
    # inside an organization's day: its stretches between removals, and each row's running sums, of all and of what follows a first top-up
    rows = rows.withColumn("day", F.to_date("at"))
    upto, earlier = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    today = Window.partitionBy("org_id", "day").orderBy("at", "step", "id").rowsBetween(*upto)
    stretch = Window.partitionBy("org_id", "day", "_cut").orderBy("at", "step", "id").rowsBetween(*upto)
    rows = rows.withColumn("_cut", F.count_if("removal").over(today)).withColumn("_begun", F.bool_or((F.col("step") == 0) & ~F.col("removal")).over(stretch))
    rows = rows.withColumns({"_all": F.sum("amount").over(stretch), "_own": F.sum(F.when(F.col("_begun"), F.col("amount"))).over(stretch)})
    # a day hands on what its last stretch ends with; one without a removal adds to what it was handed
    last = F.max(F.struct("_cut", "at", "step", "id", "_begun", "_all", "_own"))
    days = rows.groupBy("org_id", "day").agg(last.alias("m")).select("org_id", "day", "m.*")
    days = days.withColumn("_part", F.coalesce(F.sum((F.col("_cut") > 0).cast("int")).over(Window.partitionBy("org_id").orderBy("day").rowsBetween(*upto)), F.lit(0)))
    entry = Window.partitionBy("org_id", "_part").orderBy("day")  # from a day with a removal to the next such day
    whole = F.coalesce(F.bool_or("_begun").over(entry.rowsBetween(*earlier)), F.lit(False)) & (F.col("_cut") == 0)
    days = days.withColumn("_adds", F.when(whole, F.col("_all")).otherwise(F.coalesce("_own", F.lit(0))))
    days = days.withColumns({"_on": F.bool_or("_begun").over(entry.rowsBetween(*upto)), "_sum": F.sum("_adds").over(entry.rowsBetween(*upto))})
    next_day = Window.partitionBy("org_id").orderBy("day")
    days = days.select("org_id", "day", F.coalesce(F.lag("_on").over(next_day), F.lit(False)).alias("_started"), F.coalesce(F.lag("_sum").over(next_day), F.lit(0)).alias("_before"))
    rows = rows.join(days, ["org_id", "day"])
    goes_on = F.col("_started") & (F.col("_cut") == 0)
    balance = F.when(goes_on, F.col("_before") + F.coalesce("_all", F.lit(0))).when(F.col("_begun"), F.col("_own"))
    return rows.select("org_id", "at", F.when(F.col("step") == 0, "topup").otherwise("charge").alias("kind"), "id", "amount", F.when(~F.col("removal"), balance).alias("balance"))


def limit_audit(usage: DataFrame, caps: DataFrame) -> DataFrame:
    """Month-to-date spend before each call of every capped scope, and the call that crossed the cap.

    caps: scope, key, cap_usd. A scope's totals of bins of the time give the offset of every bin (a window over few
    rows), and the running sum inside a bin is keyed by (scope, key, month, bin). Caps meet these totals, not the calls: a join of the calls by (scope, key)
    would leave the platform's single key in a single task, windows included.
    """
    usage = usage.withColumns({"_us": F.unix_micros(F.col("at").cast("timestamp")), "month": month_of(F.col("at"))})
    calls = spend_scopes(usage.withColumn("_bin", bin_of(usage, "_us"))).select("scope", "key", "month", "_bin", "at", "id", "amount")
    totals = calls.groupBy("scope", "key", "month", "_bin").agg(F.sum("amount").alias("total")).join(caps, ["scope", "key"])
    before = Window.partitionBy("scope", "key", "month", "cap_usd").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.withColumn("earlier", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    inside = Window.partitionBy("scope", "key", "month", "_bin").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumn("inside", F.coalesce(F.sum("amount").over(inside), F.lit(0))).join(earlier, ["scope", "key", "month", "_bin"])
    spent = (F.col("earlier") + F.col("inside")).cast("double")
    crossed = (spent < F.col("cap_usd").cast("double")) & (spent + F.col("amount").cast("double") >= F.col("cap_usd").cast("double"))
    return out.select("scope", "key", "id", "at", F.round(spent, 9).alias("spent_before"), crossed.alias("crossed"))


def gate_calls(pending: DataFrame, spend: DataFrame, billing: DataFrame, limits: DataFrame, month: str, ceiling: float) -> DataFrame:
    """Which refusal a pending call meets, if any: BUDGET, ORG_BALANCE, ITEM_LIMIT, MEMBER_LIMIT in this order."""
    now = spend.where(F.col("month") == F.lit(month).cast("date"))
    total = now.where("scope = 'platform'").agg(F.coalesce(F.sum("spent_usd"), F.lit(0)).cast("double").alias("_total"))  # one row
    item = now.where("scope = 'item'").select(F.col("key").alias("_ik"), F.col("spent_usd").alias("_is"))
    member = now.where("scope = 'member'").select(F.col("key").alias("_mk"), F.col("spent_usd").alias("_ms"))
    il = limits.where("kind <> 'member'").select("org_id", F.col("kind").alias("item_type"), F.col("target_id").alias("item_id"), F.col("monthly_usd").alias("_il"))
    ml = limits.where("kind = 'member'").select("org_id", F.col("target_id").alias("user_id"), F.col("monthly_usd").alias("_ml"))
    out = (
        pending.withColumns({"_ik": F.concat_ws(":", "org_id", "item_type", "item_id"), "_mk": F.concat_ws(":", "org_id", "user_id")})
        .join(item, "_ik", "left").join(member, "_mk", "left").join(il, ["org_id", "item_type", "item_id"], "left").join(ml, ["org_id", "user_id"], "left")
        .join(billing.select("org_id", "balance_usd"), "org_id", "left").crossJoin(F.broadcast(total))
    )
    none = F.lit(0)
    refusal = (
        F.when(F.col("_total") >= ceiling, "BUDGET")
        .when(F.col("balance_usd") <= 0, "ORG_BALANCE")
        .when(F.coalesce("_is", none) >= F.col("_il"), "ITEM_LIMIT")
        .when(F.coalesce("_ms", none) >= F.col("_ml"), "MEMBER_LIMIT")
    )
    return out.select(*pending.columns, refusal.alias("refusal"))


def orphan_limits(limits: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Limits on what their organization doesn't have."""
    there = items.select("org_id", "kind", F.col("id").alias("target_id")).unionByName(users.select("org_id", F.lit("member").alias("kind"), F.col("id").alias("target_id")))
    return limits.join(there, ["org_id", "kind", "target_id"], "left_anti")


def estimate_costs(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """The most a request can cost: characters / 3 + 50 tokens in, allowed tokens out. requests: model, texts, pictures, max_tokens."""
    chars = F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x), F.lit(0))) + F.coalesce("pictures", F.lit(0)) * 4500
    asked = F.when(F.col("max_tokens") > 0, F.least("max_tokens", F.lit(MOST_OUTPUT))).otherwise(DEFAULT_OUTPUT)
    priced = F.col("input_per_m").isNotNull() & F.col("output_per_m").isNotNull()
    price = lambda c, i: F.when(priced, F.col(c)).otherwise(FALLBACK_PRICE[i])
    out = requests.join(catalog, "model", "left")
    return out.withColumn("estimate_usd", F.round(((F.ceil(chars / 3) + 50) * price("input_per_m", 0) + asked * price("output_per_m", 1)) / 1e6, 6)).select(*requests.columns, "estimate_usd")


def effective_models(people: DataFrame, billing: DataFrame, platform_default: str) -> DataFrame:
    """The model each row runs on: its own while its organization allows it, else the organization's default, else the platform's.

    people: org_id, own_model; billing: org_id, default_model, allowed_models.
    """
    default = F.coalesce(F.nullif(F.col("default_model"), F.lit("")), F.lit(platform_default))
    allowed = F.coalesce(F.array_contains("allowed_models", F.col("own_model")), F.lit(False)) | (F.col("own_model") == default)
    out = people.join(billing.select("org_id", "default_model", "allowed_models"), "org_id", "left")
    return out.select(*people.columns, F.when(F.coalesce(allowed, F.lit(False)), F.col("own_model")).otherwise(default).alias("model"))


def org_price_list(catalog: DataFrame, billing: DataFrame) -> DataFrame:
    """Each organization's prices of the catalog's models: catalog x (1 + markup), 4 places.

    Catalog and organizations meet on a constant; which side is sent to the other is left to adaptive execution.
    """
    factor = 1 + F.coalesce(F.col("markup_pct"), F.lit(0)).cast("double") / 100
    rows = billing.select("org_id", factor.alias("_f"), F.lit(0).alias("_c")).join(catalog.withColumn("_c", F.lit(0)), "_c")
    return rows.select("org_id", "model", F.round(F.col("input_per_m") * F.col("_f"), 4).alias("input_per_m"), F.round(F.col("output_per_m") * F.col("_f"), 4).alias("output_per_m"))

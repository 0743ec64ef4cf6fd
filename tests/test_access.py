"""Who may see what, by hand."""

from __future__ import annotations

from botlake.operators import access


def test_levels_by_hand(spark):
    users = spark.createDataFrame(
        [("root", True, "o1", "member", "none"), ("boss", False, "o1", "admin", "none"), ("viewer", False, "o1", "member", "view"), ("none", False, "o1", "member", "none"), ("other", False, "o2", "admin", "edit")],
        "id string, is_admin boolean, org_id string, org_role string, org_access string",
    )
    items = spark.createDataFrame([("agent", "a", "o1"), ("agent", "b", "o2"), ("app", "a", "o2")], "kind string, id string, org_id string")
    grants = spark.createDataFrame([("viewer", "agent", "a", "edit"), ("none", "agent", "a", "view"), ("boss", "agent", "a", "none"), ("other", "agent", "a", "edit"), ("none", "agent", "b", "edit")], "user_id string, kind string, item_id string, level string")
    levels = access.access_levels(users, items, grants)
    rows = spark.createDataFrame([(u, i) for u in ("root", "boss", "viewer", "none", "other") for i in ("a", "b", "gone")], "user string, item string")
    got = {(r["user"], r["item"]): r["level"] for r in access.levels_of(rows, levels, users, items, "agent", "item", "user").collect()}
    want = {("root", "a"): "edit", ("root", "b"): "edit", ("boss", "a"): "edit", ("viewer", "a"): "edit", ("none", "a"): "view", ("other", "b"): "edit"}
    assert got == {k: want.get(k, "none") for k in got} and len(got) == 15
    assert {tuple(r) for r in access.visible(rows, levels, users, items, "agent", "item", "user").collect()} == set(want)

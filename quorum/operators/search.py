"""Search and facets of members and bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import civic

# The types of bills that a kind stands for.
KINDS = {"bills": ("hr", "s"), "joint": ("hjres", "sjres"), "concurrent": ("hconres", "sconres"), "simple": ("hres", "sres")}


def with_facets(bills: DataFrame, text: str | None = None, bill_type: str | None = None, kind: str | None = None, chamber: str | None = None, policy_area: str | None = None) -> DataFrame:
    """bills (title, bill_type, policy_area, ...) under all facets that are given: a part of the title in either case, a type, a kind of types, the chamber where types begin with its letter, a policy area. An unknown kind is an error."""
    held: list[Column] = []
    if text:
        held.append(F.lower("title").contains(text.lower()))
    if bill_type:
        held.append(F.col("bill_type") == bill_type.lower())
    if kind:
        held.append(F.col("bill_type").isin(*KINDS[kind]))
    if chamber:
        held.append(F.col("bill_type").startswith("h" if chamber == "house" else "s"))
    if policy_area:
        held.append(F.col("policy_area") == policy_area)
    for h in held:
        bills = bills.filter(h)
    return bills


def found_members(members: DataFrame, text: str, limit: int) -> DataFrame:
    """members (member, full_name, last_name, state, chamber) whose name holds text or whose state it is, by chamber, name and member; with fewer than two characters none. Text is taken literally."""
    q = text.strip().lower()
    if len(q) < 2:
        return members.limit(0)
    hit = F.lower("full_name").contains(q) | F.lower("last_name").contains(q) | (F.lower("state") == q)
    return members.filter(hit).orderBy("chamber", "last_name", "member").limit(limit)


def found_bills(bills: DataFrame, text: str, limit: int) -> DataFrame:
    """bills (bill_id, bill_type, number, title, active_at) that text names by type and number (rank 0) or number (1), or whose title holds it (2); the best rank first, then the latest; with fewer than two characters none."""
    q = text.strip().lower()
    if len(q) < 2:
        return bills.limit(0).withColumn("rank", F.lit(0))
    named = civic.bill_of_label(F.regexp_replace(F.lit(q), r"^([a-z.\s]*?)\s*\.?\s*(\d{1,5})$", "$1 $2"))
    exact = F.coalesce((F.col("bill_type") == named["bill_type"]) & (F.col("number") == named["number"]), F.lit(False))
    bare = q.replace(".", "").replace(" ", "")
    number = F.col("number") == int(bare) if bare.isdigit() and len(bare) <= 18 else F.lit(False)
    hit = exact | number | F.lower("title").contains(q)
    rank = F.when(exact, 0).when(number, 1).otherwise(2)
    return bills.filter(hit).withColumn("rank", rank).orderBy("rank", F.desc_nulls_last("active_at"), "bill_id").limit(limit)


def nested_committees(committees: DataFrame) -> DataFrame:
    """(committee_code, name, chamber, is_sub, parent_code, parent_name) of committees (committee_code, name, chamber, committee_type, parent_code): subcommittees with their parent, found in the same table, those without one left out.

    In a list they go by chamber, type (descending), parent's name and code, the parent before its parts, and name.
    """
    main = committees.filter("committee_type <> 'subcommittee'").select(F.col("committee_code").alias("parent_code"), F.col("name").alias("parent_name"), F.col("committee_type").alias("parent_type"), F.col("chamber").alias("parent_chamber"))
    subs = committees.filter("committee_type = 'subcommittee'").select("committee_code", "name", "chamber", "parent_code").join(main, "parent_code")
    columns = ["committee_code", "name", "chamber", "parent_code", "parent_name", "parent_type", "parent_chamber"]
    own = main.select(F.col("parent_code").alias("committee_code"), F.col("parent_name").alias("name"), F.col("parent_chamber").alias("chamber"), "parent_code", "parent_name", "parent_type", "parent_chamber")
    return own.withColumn("is_sub", F.lit(False)).unionByName(subs.select(*columns).withColumn("is_sub", F.lit(True)))


def committee_order() -> list[Column]:
    """The order of nested_committees in a list."""
    return [F.col("parent_chamber"), F.desc("parent_type"), *[F.col(c) for c in ("parent_name", "parent_code", "is_sub", "name", "committee_code")]]

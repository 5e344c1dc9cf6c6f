"""Lookups of single rows, roll-ups of runs and what is left to export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from folioscope.functions.text import filled, first_filled


def one_row(df: DataFrame, hit: Column) -> Row:
    """The row of a unique key; an error if there is none."""
    found = df.filter(hit).limit(1).collect()
    if not found:
        raise LookupError("no row has this key")
    return found[0]


def any_row(df: DataFrame, hit: Column) -> bool:
    """Whether there is a row, without reading on after the first."""
    return bool(df.filter(hit).limit(1).collect())


def accounts_named(found: DataFrame, name: str, column: str = "nickname") -> tuple[DataFrame, int]:
    """Hits whose name is exactly the name, and how many; an error if there is none."""
    own = found.filter(F.col(column) == name)
    n = own.count()
    if not n:
        raise LookupError(f"no account is named {name}")
    return own, n


def by_name(df: DataFrame, name: str) -> DataFrame:
    """Rows by name in lower case, then by the name as it is."""
    return df.orderBy(F.lower(name), name)


def store_coverage(products: DataFrame) -> DataFrame:
    """One row: products, and those with a play link, a store link, a package and hints."""
    return products.agg(F.count("*").alias("products"), *[F.count_if(F.coalesce(F.col(c) != "", F.lit(False))).alias(f"with_{c}") for c in ("google_play", "app_store", "package_id")], F.count_if(F.coalesce(F.size("hints") > 0, F.lit(False))).alias("with_hints"))


def discovery_metrics(candidates: DataFrame, requests: DataFrame, by: str) -> DataFrame:
    """Per key: candidates, exact ones, rejected and verified articles; search requests, pages that came, and retries of empty ones.

    candidates: exact, verified, link; requests: ok, retry. Verified articles count once a link.
    """
    found = candidates.groupBy(by).agg(F.count("*").alias("candidates"), F.count_if("exact").alias("exact_candidates"), F.count_if(F.col("exact") & ~F.col("verified")).alias("rejected"), F.count_distinct(F.when(F.col("verified"), F.col("link"))).alias("verified"))
    asked = requests.groupBy(by).agg(F.count("*").alias("requests"), F.count_if("ok").alias("pages"), F.count_if("retry").alias("retries"))
    names = ("candidates", "exact_candidates", "rejected", "verified", "requests", "pages", "retries")
    return found.join(asked, by, "full").select(by, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names])


def sync_rollup(results: DataFrame) -> DataFrame:
    """One row of a batch of accounts (account, nickname, coverage, error): complete, partial and failed, who failed and why, and the state of the whole."""
    failed = filled("error").isNotNull()
    complete = ~failed & (F.coalesce("coverage", F.lit("")) == "complete")
    named = F.concat(first_filled("nickname", "account"), F.lit("（"), "error", F.lit("）"))
    rows = results.agg(F.count_if(complete).alias("complete"), F.count_if(~failed & ~complete).alias("partial"), F.count_if(failed).alias("failed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("account", named.alias("n"))))), lambda s: s["n"]), "、").alias("failures"))
    return rows.withColumn("state", F.when(F.col("failed") > 0, "error").when(F.col("partial") > 0, "warning").otherwise("success"))


def export_state(exported: Column, cached: Column, force: bool = False) -> Column:
    """skip, cached or remote of a target; force: nothing is skipped."""
    rest = F.when(F.coalesce(cached, F.lit(False)), "cached").otherwise("remote")
    return rest if force else F.when(F.coalesce(exported, F.lit(False)), "skip").otherwise(rest)


def overdue(state: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Accounts whose last whole audit is `days` or more ago, or that had none, with the floor from which they are read again.

    state: account, audited_at, floor. A floor moves on only by a run that succeeded, so the stored
    one stands.
    """
    due = F.col("audited_at").isNull() | (now - F.col("audited_at") >= days * 86400)
    return state.filter(due).select("account", F.coalesce("floor", now - 366 * 86400).alias("floor"))


def stop_reason(page: dict[str, Column], floor: Column, watermark: Column, overlap_pages: Column, allowed: Column) -> Column:
    """Why a scan ends at a page: complete (no more), date-floor, overlap, partial (a source that gives no more pages), first-page (only one is wanted); null: it goes on.

    page: count, oldest, known, last, partial, single. A page that does not advance is an error.
    """
    return (
        F.when(~page["advances"], F.lit("not-advancing"))
        .when(page["count"] == 0, F.lit("complete"))
        .when(page["oldest"] < floor, F.lit("date-floor"))
        .when((page["oldest"] <= watermark) & (overlap_pages >= allowed), F.lit("overlap"))
        .when(page["partial"], F.lit("partial"))
        .when(page["single"], F.lit("first-page"))
    )


def missing_evidence(linked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entries that need evidence and have none: missing ones, and matched ones whose link is not stable.

    linked: entry, status, stable; evidence: entry. A recovery goes on only where this is empty.
    """
    need = (F.col("status") == "missing") | (F.col("status").isin("matched", "date-mismatch") & ~F.coalesce("stable", F.lit(False)))
    return linked.filter(need).join(evidence.select("entry").distinct(), "entry", "left_anti").select("entry", "status")


def account_repairs(rows: DataFrame, found: DataFrame, placeholder: str) -> DataFrame:
    """(aid, fakeid): the account that a page names for each row whose account is the placeholder."""
    named = found.filter(filled("biz").isNotNull()).groupBy("link").agg(F.min("biz").alias("fakeid"))
    return rows.filter(F.col("fakeid") == placeholder).select("aid", "link").join(named, "link").select("aid", "fakeid")

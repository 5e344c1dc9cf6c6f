"""A catalog against local files: its own soundness, links by title and date, what is repaired."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions.text import _c, relaxed_title_key, title_key
from folioscope.operators import graphs
from folioscope.session import cut_lineage

#: How a catalog entry was linked, in the order tried (fixed values).
TIERS = ("title-and-date", "title-and-path-date", "unique-title", "unique-relaxed-title")


def catalog_problems(entries: DataFrame, account: str, at: str, date: str, facts: DataFrame, boundary: str) -> DataFrame:
    """(account, problem): why an account's catalog does not prove that it reaches back beyond boundary.

    entries: account, at (the place, from 1), date; facts, a row an account: loaded, initial,
    initial_oldest, oldest, steps, reached. Entries must be as many as were loaded and have dates
    that never rise; the last entry of the first batch and the last of all must have the dates that
    were reported; unless the first batch crosses the boundary, the list must have grown by scrolling.
    """
    w = W.partitionBy(account).orderBy(at)
    good = F.coalesce(F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    seen = entries.select(F.col(account).alias("__a"), F.col(at).alias("__at"), F.col(date).alias("__d"), good.alias("__ok"), F.coalesce(F.col(date) > F.lag(date).over(w), F.lit(False)).alias("__rises"))
    held = seen.join(facts.select(F.col(account).alias("__a"), "initial"), "__a", "left").groupBy("__a").agg(
        F.count("*").alias("n"), F.bool_and("__ok").alias("dated"), F.bool_or("__rises").alias("rises"), F.max(F.when(F.col("__at") == F.col("initial"), F.col("__d"))).alias("first_end"),
        F.max_by("__d", "__at").alias("end"), F.coalesce(F.bool_or(F.col("__d") < boundary), F.lit(False)).alias("crossed"),
    )
    both = facts.join(held, facts[account] == F.col("__a"), "left")
    whole = F.col("initial_oldest") < boundary
    checks = (
        ("no entries", F.coalesce("n", F.lit(0)) == 0),
        ("loaded count differs", F.col("loaded") != F.col("n")),
        ("no initial count", F.coalesce("initial", F.lit(0)) < 1),
        ("initial count too large", F.col("initial") > F.col("n")),
        ("bad date", ~F.col("dated")),
        ("dates rise", F.col("rises")),
        ("initial date differs", ~F.col("initial_oldest").eqNullSafe(F.col("first_end"))),
        ("oldest date differs", ~F.col("oldest").eqNullSafe(F.col("end"))),
        ("no scroll", ~whole & (F.coalesce("steps", F.lit(0)) < 1)),
        ("no growth", ~whole & (F.col("loaded") <= F.col("initial"))),
        ("boundary not crossed", ~(F.coalesce("reached", F.lit(False)) & F.coalesce("crossed", F.lit(False)))),
    )
    found = F.filter(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in checks]), lambda p: p.isNotNull())
    return both.select(F.col(account), F.explode(found).alias("problem"))


def link_catalog(catalog: DataFrame, local: DataFrame, boundary: str) -> DataFrame:
    """entry, file, status and tier of every catalog row (entry, title, date) from boundary on, against local (file, title, date).

    Titles are compared normalised. An entry takes the one local file of its title with its date, else
    the one whose path holds the date, else the only one if no other entry has the title; without a
    file of its title it takes the only one of its relaxed title, if no other entry has that. Each
    file is taken once, in the order of entries. status: matched, date-mismatch, ambiguous (files of
    the title are left) or missing.

    Entries whose title no other has depend on no order and are linked by joins. Titles that several
    entries share are linked by `_choices`, one title in many tasks. Dates are days of ten characters;
    a date of another form is in no path of a shared title.
    """
    own = catalog.filter(F.col("date") >= boundary).select("entry", title_key("title").alias("k"), relaxed_title_key("title").alias("r"), "date")
    here = local.select("file", title_key("title").alias("k"), relaxed_title_key("title").alias("r"), F.col("date").alias("local_date"))
    shared = own.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    alone = own.join(shared, "k", "left_anti")
    pairs = alone.join(here.select("k", "file", "local_date"), "k")
    on_date, on_path = F.col("date") == F.col("local_date"), F.col("file").contains(F.replace("date", F.lit("-"), F.lit("")))

    def only(hit: Column, name: str) -> list[Column]:
        return [F.count_if(hit).alias(f"n_{name}"), F.min(F.when(hit, F.struct("file", "local_date"))).alias(f"l_{name}")]

    some = pairs.groupBy("entry").agg(*only(on_date, "date"), *only(on_path, "path"), *only(F.lit(True), "all"))
    relaxed_once = own.groupBy("r").agg(F.count("*").alias("n")).filter("n = 1").select("r")
    one = here.groupBy("r").agg(F.count("*").alias("n"), F.min(F.struct("file", "local_date")).alias("l_relaxed")).filter("n = 1").drop("n").join(relaxed_once, "r", "left_semi")
    tried = alone.join(some, "entry", "left").join(one, "r", "left")
    none = F.col("n_all").isNull()
    tier = F.when(F.col("n_date") == 1, 0).when(F.col("n_path") == 1, 1).when(F.col("n_all") == 1, 2).when(none & F.col("l_relaxed").isNotNull(), 3)
    taken = F.when(tier == 0, F.col("l_date")).when(tier == 1, F.col("l_path")).when(tier == 2, F.col("l_all")).when(tier == 3, F.col("l_relaxed"))
    linked = tried.select("entry", "date", taken["file"].alias("file"), taken["local_date"].alias("local_date"), tier.alias("tier"), none.alias("none"))

    several = own.join(shared, "k", "left_semi").select("k", "entry", "date")
    theirs = here.join(shared, "k", "left_semi").groupBy("k", "file").agg(F.min("local_date").alias("local_date"))
    taken_by = cut_lineage(_choices(several, theirs))
    of_title = theirs.groupBy("k").agg(F.count("*").alias("files"))
    used = several.join(taken_by, "entry").groupBy("k").agg(F.count("*").alias("used"), F.max("entry").alias("last"))
    chosen = several.join(taken_by, "entry", "left").join(of_title, "k", "left").join(used, "k", "left")
    gone = F.col("files").isNull() | ((F.col("used") == F.col("files")) & (F.col("entry") > F.col("last")))
    both = linked.unionByName(chosen.select("entry", "date", "file", "local_date", "tier", (F.col("tier").isNull() & F.coalesce(gone, F.lit(False))).alias("none")))
    status = F.when(F.col("tier").isNotNull(), F.when(F.col("date") == F.col("local_date"), "matched").otherwise("date-mismatch")).when(F.col("none"), "missing").otherwise("ambiguous")
    return both.select("entry", "date", "file", "local_date", status.alias("status"), F.get(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")).alias("tier"))


def _choices(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(entry, file, local_date, tier) of the entries (k, entry, date) that take a file (k, file, local_date) of their shared title.

    In the order of entries, one takes the only free file of its title and date, else the only free
    one whose path holds its date. All entries of one title and date look at the same files, and only
    the last file of a kind is ever taken, so a title and date takes two files at most. Where none of
    its files is looked at by another date of the title, which two follows from counts. Titles and
    dates that look at a file together are a component, and only within it does the order matter: a
    component is walked through by one task, with work in proportion to its entries and files.
    """
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.replace("date", F.lit("-"), F.lit("")))
    days = entries.select("k", "date", day.alias("day")).distinct()
    of_date = days.join(files.withColumnRenamed("local_date", "date"), ["k", "date"]).select("k", "date", "file", F.col("date").alias("local_date"), F.lit(True).alias("d"), F.lit(False).alias("p"))
    in_path = files.select("k", "file", "local_date", F.explode(F.array_distinct(F.regexp_extract_all("file", F.lit(r"(?=(\d{8}))"), F.lit(1)))).alias("day"))
    of_path = in_path.join(days, ["k", "day"]).select("k", "date", "file", "local_date", F.lit(False).alias("d"), F.lit(True).alias("p"))
    looked = cut_lineage(of_date.unionByName(of_path).groupBy("k", "date", "file").agg(F.min("local_date").alias("local_date"), F.bool_or("d").alias("d"), F.bool_or("p").alias("p")))
    node = F.struct("k", "date")
    many = looked.groupBy("k", "file").agg(F.count("*").alias("n"), F.min("date").alias("least")).filter("n > 1").drop("n")
    links = looked.join(many, ["k", "file"]).select(node.alias("u"), F.struct("k", F.col("least").alias("date")).alias("v"))
    root_of = graphs.components(links).select("node.k", "node.date", "root")
    # alone: the first two entries of a title and date
    alone = looked.join(root_of, ["k", "date"], "left_anti")
    file = F.struct("file", "local_date")

    def only(hit: Column, name: str) -> list[Column]:
        return [F.count_if(hit).alias(f"n_{name}"), F.min(F.when(hit, file)).alias(f"f_{name}")]

    sums = alone.groupBy("k", "date").agg(*only(F.col("d"), "d"), *only(F.col("p"), "p"), *only(F.col("d") & ~F.col("p"), "d_alone"), *only(F.col("p") & ~F.col("d"), "p_alone"))
    by_date, by_path = F.col("n_d") == 1, F.col("n_p") == 1

    def choice(hit: Column, name: str, tier: int) -> Column:
        return F.when(hit, F.struct(F.col(f"f_{name}.file").alias("file"), F.col(f"f_{name}.local_date").alias("local_date"), F.lit(tier).alias("tier")))

    first = F.coalesce(choice(by_date, "d", 0), choice(by_path, "p", 1))
    second = F.when(by_date, choice(F.col("n_p_alone") == 1, "p_alone", 1)).when(by_path, choice(F.col("n_d_alone") == 1, "d_alone", 0))
    nth = entries.withColumn("nth", F.row_number().over(W.partitionBy("k", "date").orderBy("entry"))).filter("nth <= 2")
    plain = nth.join(sums, ["k", "date"]).select("entry", F.when(F.col("nth") == 1, first).otherwise(second).alias("c")).filter("c IS NOT NULL").select("entry", "c.*")

    def walk(own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        at: dict = {}
        holders: dict = {}
        for date, name, local, d, p in seen[["s_date", "s_file", "s_local_date", "s_d", "s_p"]].itertuples(index=False):
            free = at.setdefault(date, (dict(), dict()))
            for n, hit in enumerate((d, p)):
                if hit:
                    free[n][name] = local
            holders.setdefault(name, []).append(date)
        out = []
        for entry, date in own.sort_values("entry")[["entry", "day"]].itertuples(index=False):
            for tier, free in enumerate(at.get(date, ())):
                if len(free) == 1:
                    name, local = next(iter(free.items()))
                    out.append((entry, name, local, tier))
                    for other in holders[name]:
                        for kind in at[other]:
                            kind.pop(name, None)
                    break
        return pd.DataFrame(out, columns=["entry", "file", "local_date", "tier"])

    # both sides stem from the entries: their columns get names of their own before they meet
    component = F.to_json("root").alias("component")
    tied = entries.join(root_of, ["k", "date"]).select(component, "entry", F.col("date").alias("day"))
    theirs = looked.join(root_of, ["k", "date"]).select(component, *[F.col(c).alias(f"s_{c}") for c in ("date", "file", "local_date", "d", "p")])
    return plain.unionByName(tied.groupBy("component").cogroup(theirs.groupBy("component")).applyInPandas(walk, plain.schema))


def audit_summary(linked: DataFrame) -> DataFrame:
    """One row: eligible entries, matched (mismatched dates among them), missing, ambiguous and date mismatches."""
    n = {s: F.count_if(F.col("status") == s) for s in ("matched", "date-mismatch", "missing", "ambiguous")}
    return linked.agg(F.count("*").alias("eligible"), (n["matched"] + n["date-mismatch"]).alias("matched"), n["missing"].alias("missing"), n["ambiguous"].alias("ambiguous"), n["date-mismatch"].alias("date_mismatches"))


def patched_frontmatter(text: Column | str, key: str, have: Column | str, want: Column | str, quote: bool = True) -> Column:
    """text with the one line of key in its leading block set to want, if it holds have; else an error when it is read."""
    block = F.regexp_extract(_c(text), r"(?s)^(---\r?\n.*?\r?\n---)(?:\r?\n|$)", 1)
    lines = F.regexp_extract_all(block, F.lit(rf"(?m)^{key}:[ \t]*([^\r\n]*)"), F.lit(1))
    held = F.regexp_replace(F.trim(F.get(lines, F.lit(0))), r"""^(["'])(.*)\1$""", "$2")
    value = F.concat(F.lit(f"{key}: "), F.to_json(F.array(_c(want))).substr(F.lit(2), F.char_length(F.to_json(F.array(_c(want)))) - 2) if quote else _c(want))
    # the line is put in by its place, as a value may hold what a replacement takes for a reference
    before = F.regexp_extract(block, rf"(?s)^(.*?\n){key}:[^\r\n]*", 1)
    after = F.regexp_extract(block, rf"(?s)^.*?\n{key}:[^\r\n]*(.*)$", 1)
    rest = _c(text).substr(F.char_length(block) + 1, F.char_length(_c(text)))
    broken = F.when(F.size(lines) != 1, F.lit(f"not one line of {key}")).when(~held.eqNullSafe(_c(have)), F.lit(f"{key} changed since the audit"))
    return F.when(broken.isNotNull(), F.raise_error(broken)).otherwise(F.concat(before, value, after, rest))

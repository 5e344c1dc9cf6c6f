"""Output directories of articles: templates, unique paths and their check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions.text import _c, date_slug, path_segment, safe_filename

#: Longest directory names, names for what is missing, and hash lengths tried on a collision (fixed values).
ACCOUNT_LENGTH, TITLE_LENGTH = 80, 120
UNKNOWN_ACCOUNT, UNTITLED = "unknown", "untitled"
HASH_LENGTHS = (8, 12, 16, 40)


def directory(account: Column | str, title: Column | str) -> Column:
    return F.concat_ws("/", path_segment(account, UNKNOWN_ACCOUNT, ACCOUNT_LENGTH), path_segment(title, UNTITLED, TITLE_LENGTH))


def from_template(template: str, account: Column, title: Column, aid: Column, author: Column, updated: Column, most: int | None = None) -> Column:
    """A directory name with ${account}, ${title}, ${aid}, ${author}, ${YYYY}, ${MM}, ${DD}, ${HH} and ${mm} filled in."""
    out = F.lit(template)
    at = F.timestamp_seconds(updated)
    parts = {"account": safe_filename(account), "title": safe_filename(title), "aid": aid, "author": author, "YYYY": F.date_format(at, "yyyy"), "MM": F.date_format(at, "MM"), "DD": F.date_format(at, "dd"), "HH": F.date_format(at, "HH"), "mm": F.date_format(at, "mm")}
    for name, value in parts.items():
        out = F.replace(out, F.lit(f"${{{name}}}"), F.coalesce(value, F.lit("")))
    return F.left(out, F.lit(most)) if most else out


def plan_paths(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(url, path) for each distinct normalised url of rows (account, title, date, url, seq).

    A URL that existing (path, url) holds keeps its path. Otherwise the first URL of a directory
    takes it unless it is occupied; others get the date and hex digits of the URL's SHA-1, more
    digits and then a number as long as existing or this plan holds that too. First places are found by minima, which
    combine before the shuffle, so a directory that many articles share meets in no single task.
    """
    first = rows.groupBy("url").agg(F.min_by(F.struct("account", "title", "date", "seq"), "seq").alias("r"))
    todo = first.select("url", "r.seq", directory("r.account", "r.title").alias("base"), date_slug("r.date").alias("day"))
    kept = None
    held = None
    if existing is not None:
        kept = existing.filter(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(F.min("path").alias("path"))
        todo = todo.join(kept, "url", "left_anti")
        held = existing.select(F.col("path").alias("base")).distinct()
    free = todo if held is None else todo.join(held, "base", "left_anti")
    leaders = free.groupBy("base").agg(F.min(F.struct("seq", "url")).alias("l")).select("base", F.col("l.url").alias("lead"))
    marked = todo.join(leaders, "base", "left").withColumn("leads", F.coalesce(F.col("lead") == F.col("url"), F.lit(False)))
    own = marked.filter("leads").select("url", F.col("base").alias("path"))
    others = marked.filter("not leads").withColumn("hash", F.sha1("url"))

    def suffixed(digits: int) -> Column:
        return F.concat(F.col("base"), F.lit("--"), F.when(F.col("day") != "", F.concat("day", F.lit("-"))).otherwise(""), F.left("hash", F.lit(digits)))

    # of each URL's suffixed paths those that nothing else holds, the shortest first
    taken = own.select(F.col("path").alias("tried")) if held is None else own.select(F.col("path").alias("tried")).unionByName(held.select(F.col("base").alias("tried")))
    tries = F.posexplode(F.array(*[suffixed(d) for d in HASH_LENGTHS])).alias("k", "tried")
    open_paths = others.select("url", tries).join(taken.distinct(), "tried", "left_anti").groupBy("url").agg(F.array_sort(F.collect_list(F.struct("k", "tried"))).alias("open"))
    # numbers at the end of full-length paths that are held
    whole = r"^(.*--(?:\d{8}-)?[0-9a-f]{40})-(\d+)$"
    used = taken.select(F.regexp_extract("tried", whole, 1).alias("full"), F.regexp_extract("tried", whole, 2).try_cast("int").alias("number")).filter("full <> ''").groupBy("full").agg(F.max("number").alias("used"))
    n = F.row_number().over(W.partitionBy("short").orderBy("seq", "url"))
    numbered = others.withColumn("short", suffixed(HASH_LENGTHS[0])).withColumn("full", suffixed(HASH_LENGTHS[-1])).withColumn("n", n).join(open_paths, "url", "left").join(used, "full", "left")
    beyond = F.greatest(F.lit(1), F.coalesce("used", F.lit(1))) + F.col("n") - F.coalesce(F.size("open"), F.lit(0))
    path = F.when(F.col("n") <= F.coalesce(F.size("open"), F.lit(0)), F.get("open", F.col("n") - 1)["tried"]).otherwise(F.concat("full", F.lit("-"), beyond.cast("string")))
    out = own.unionByName(numbered.select("url", path.alias("path")))
    if kept is not None:
        out = out.unionByName(kept.join(rows.select("url").distinct(), "url", "left_semi"))
    return out


def clashing_paths(plan: DataFrame) -> DataFrame:
    """Paths that more than one URL would write; empty if the plan is sound."""
    return plan.distinct().groupBy("path").agg(F.count("*").alias("urls")).filter("urls > 1")


def in_scope(path: Column | str, root: str, accounts: list[str] | None = None) -> Column:
    """Whether a path below root is an article's: no part begins with an underscore, of one of the accounts if any are named."""
    relative = F.when(F.startswith(_c(path), F.lit(f"{root}/")), F.substr(_c(path), F.lit(len(root) + 2)))
    parts = F.split(relative, "/")
    ok = ~F.exists(parts, lambda p: p.startswith("_")) & (F.element_at(parts, -1) == "index.md")
    return F.coalesce(ok & (parts[0].isin(*accounts) if accounts else F.lit(True)), F.lit(False))


def scoped_files(files: DataFrame, root: str, accounts: list[str] | None = None) -> DataFrame:
    """Distinct paths of a list (path) that are articles' below root, in order."""
    return files.filter(in_scope("path", root, accounts)).select("path").distinct().orderBy("path")

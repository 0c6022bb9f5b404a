"""Lookups of rows in small and large tables: metadata, latest known values, trust order, crawl permission, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as tx


def with_metadata(rows: DataFrame, manifest: DataFrame, key: str, position: str) -> DataFrame:
    """Rows with the manifest's other columns where the key is listed, nulls where not; of repeated keys the last entry holds."""
    columns = [c for c in manifest.columns if c not in (key, position)]
    last = manifest.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), position).alias("__m"))
    return rows.join(last, key, "left").select(*rows.columns, *(F.col(f"__m.{c}").alias(c) for c in columns))


def latest_known(rows: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with ``value`` of their key; an unknown or null key gets the value of the greatest known one."""
    dim = dimension.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("__own"))
    newest = dim.agg(F.max_by("__own", key).alias("__latest")).withColumn("__one", F.lit(1))  # one row
    return rows.join(dim, key, "left").withColumn("__one", F.lit(1)).join(F.broadcast(newest), "__one", "left").withColumn(value, F.coalesce("__own", "__latest")).drop("__own", "__one", "__latest")


def most_trusted(rows: DataFrame, group: str, kind: str, order: list[str], tie: str) -> DataFrame:
    """The row of each group whose kind comes first in ``order``; kinds not listed come last, ties by ``tie``."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(kind)), F.lit(0)), F.lit(len(order) + 1))
    n = F.row_number().over(Window.partitionBy(group).orderBy(rank, tie))
    return rows.withColumn("trust", rank.cast("int")).withColumn("__n", n).where("__n = 1").drop("__n")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(authority, allow, path) of the rules that hold for an agent, from robots texts (authority, robots).

    The groups that name the agent hold, where there are none those for ``*``. A blank path forbids and allows nothing;
    so does what stands before the first group. Of several texts of an authority the least one holds.
    """
    texts = robots.where("authority is not null and robots is not null").groupBy("authority").agg(F.min("robots").alias("robots"))
    lines = texts.select("authority", F.posexplode(F.split("robots", r"\r\n|\n|\r")).alias("no", "line"))
    field = F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)))
    value = F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:\s*([^#]*?)\s*(?:#.*)?$", 1)
    fields = lines.select("authority", "no", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("authority").orderBy("no")  # the lines of one text
    begins = (F.col("field") == "user-agent") & (F.lag("field", 1, "").over(order) != "user-agent")
    grouped = fields.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(order))
    named = F.when(F.col("value") == "*", 0).when(F.lit(agent.lower()).startswith(F.lower("value")) & (F.col("value") != ""), 1)
    agents = grouped.where("field = 'user-agent'").withColumn("named", named).where("named is not null").groupBy("authority", "group").agg(F.max("named").alias("named"))
    best = agents.withColumn("best", F.max("named").over(Window.partitionBy("authority"))).where("named = best").select("authority", "group")
    return grouped.where("field <> 'user-agent' and value <> ''").join(best, ["authority", "group"]).select("authority", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path")).distinct()


def crawlable(urls: DataFrame, robots: DataFrame, agent: str = "*", url_col: str = "url") -> DataFrame:
    """``urls`` with ``authority`` and ``allowed``: of the rules of its authority whose path the URL's begins with, the longest decides.

    Of equally long ones the allowing one does; without one, as for null URLs, all is allowed. ``*`` in a path stands for any
    characters, ``$`` at its end for the end of the URL. Equal URLs are decided once.
    """
    local = F.coalesce(F.nullif(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^#]*)", 1), F.lit("")), F.lit("/"))
    placed = urls.withColumn("authority", tx.netloc(F.col(url_col))).withColumn("__local", local)
    rules = robots_rules(robots, agent).withColumn("__like", F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"([.+?^(){}|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\$(?!$)", r"\\$")))
    met = placed.select("authority", "__local").distinct().join(rules, "authority").where(F.expr("__local rlike __like"))
    verdict = met.groupBy("authority", "__local").agg(F.max(F.struct(F.length("path").alias("size"), "allow")).alias("__rule"))
    joined = placed.join(verdict, ["authority", "__local"], "left").withColumn("allowed", F.coalesce("__rule.allow", F.lit(True)))
    return joined.select(*[c for c in urls.columns if c not in ("authority", "allowed")], "authority", "allowed")


def routes(text: Column, keywords: dict[str, list[str]]) -> list[Column]:
    """One boolean column per route: the text holds one of its words, whole and ignoring case; false for null."""
    out = []
    for name, words in keywords.items():
        pattern = r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])"
        out.append(F.coalesce(text.rlike(pattern), F.lit(False)).alias(name))
    return out

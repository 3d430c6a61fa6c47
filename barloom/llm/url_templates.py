"""URL filters by a tree of path templates, in DataFrame operations only.

Fixed rules come first. Other urls are judged by the template of their path: segments with
digits are generalised by their shape; then, level by level under each host, children of a
branch with many rare children become a wildcard, and so do others, unless their share of bad
labelled pages differs from their siblings' (two-proportion test). Those that differ to the same
side, and not among themselves, become one branch of their own. A template is blocked when
its share of bad labelled pages, smoothed towards the overall one, is high enough. The tree
works on one row per host and path shape, not on pages, and every count is aggregated before
it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))  # a parameter
FANOUT = 32  # children from which on rare ones count as values of a variable
DIFFERS = 1.96  # z score from which on a branch differs from its siblings
PRIOR = 10.0  # labelled pages that the smoothing adds at the overall share
IMPURE = 0.5  # smoothed share of bad pages from which on a template is blocked
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without `://`."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), *LOWER), F.regexp_extract(url, pattern, 2)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, or nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path with values replaced by the kind of value, without slashes at its ends."""
    path = F.regexp_replace(path, r"(?<=/)(?=[0-9a-f-]*[0-9])[0-9a-f-]{8,}(?=/|\.|\z)", "{id}")
    return F.regexp_replace(F.regexp_replace(path, "[0-9]++", "{n}"), r"\A/++|/++\z", "")


def branches(shapes: DataFrame, level: int) -> DataFrame:
    """Pages and labels per host, parent branch and child at a level (from 1)."""
    return (shapes.filter(F.size("segments") >= level)
            .groupBy("host", F.array_join(F.slice("segments", 1, level - 1), "/").alias("parent"), F.col("segments")[level - 1].alias("child"))
            .agg(F.sum("pages").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))


def starred(shapes: DataFrame, level: int, chosen: DataFrame) -> DataFrame:
    """`shapes` with the segment of a level replaced by `star` in the chosen branches (host, parent, child, star)."""
    keyed = shapes.withColumns({"parent": F.array_join(F.slice("segments", 1, level - 1), "/"), "child": F.get("segments", F.lit(level - 1))})
    marked = keyed.join(chosen, ["host", "parent", "child"], "left")
    rest = F.slice("segments", F.lit(level + 1), F.greatest(F.size("segments") - level, F.lit(0)))
    segments = F.when(F.col("star").isNotNull(), F.concat(F.slice("segments", 1, level - 1), F.array("star"), rest))
    return marked.withColumn("segments", segments.otherwise(F.col("segments"))).select(shapes.columns)


def compared(by: DataFrame, family: list[str]) -> DataFrame:
    """Branches with counts of their whole family, whether their share of bad pages differs from that of the others together, and to which side."""
    total = by.groupBy(*family).agg(F.count(F.lit(1)).alias("children"), F.sum("pages").alias("all_pages"),
                                    F.sum("labelled").alias("all"), F.sum("bad").alias("all_bad"))
    n, rest = F.col("labelled"), F.col("all") - F.col("labelled")
    share = F.col("all_bad") / F.col("all")
    gap = F.col("bad") / n - (F.col("all_bad") - F.col("bad")) / rest
    differs = (n > 0) & (rest > 0) & (F.abs(gap) >= DIFFERS * F.sqrt(share * (1 - share) * (1 / n + 1 / rest))) & (gap != 0)
    return by.join(total, family).withColumns({"differs": F.coalesce(differs, F.lit(False)), "side": F.when(gap > 0, "*bad").otherwise("*good")})


def variables(shapes: DataFrame, level: int) -> DataFrame:
    """Branches that are one of many rare children, but for those whose labels differ from their siblings'."""
    rare = (F.col("children") > FANOUT) & (F.col("pages") * FANOUT < F.col("all_pages"))
    return compared(branches(shapes, level), ["host", "parent"]).filter(rare & ~F.col("differs")).select("host", "parent", "child", F.lit("*").alias("star"))


def alike(shapes: DataFrame, level: int) -> DataFrame:
    """Branches that do not differ from their siblings, and those that differ to one side but not among themselves."""
    names = ["host", "parent", "child", "pages", "labelled", "bad"]
    first = compared(branches(shapes, level), ["host", "parent"])
    same = first.filter((F.col("children") > 1) & ~F.col("differs")).select("host", "parent", "child", F.lit("*").alias("star"))
    apart = first.filter("differs").select(*names, F.col("side").alias("star"))
    merged = compared(apart, ["host", "parent", "star"]).filter((F.col("children") > 1) & ~F.col("differs"))
    return same.unionByName(merged.select("host", "parent", "child", "star"))


def deepest(shapes: DataFrame) -> int:
    """The last level with siblings: the largest depth that two shapes of one host reach."""
    sizes = shapes.groupBy("host", F.size("segments").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("host").orderBy(F.desc("size"))
    reached = sizes.withColumn("n", F.sum("n").over(above)).filter("n > 1")
    return reached.agg(F.max("size")).first()[0] or 0


def templates(judged: DataFrame) -> DataFrame:
    """host, shape, template and blocked of each path shape. `judged`: host, path and bad (1, 0 or null)."""
    found = (judged.groupBy("host", shape(F.col("path")).alias("shape"))
             .agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    shapes = cut(found.withColumn("segments", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/+"))))
    known = shapes.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    for level in range(1, deepest(shapes) + 1):
        shapes = cut(starred(shapes, level, variables(shapes, level)))
        shapes = cut(starred(shapes, level, alike(shapes, level)))
    overall = (known["bad"] or 0) / max(known["labelled"] or 0, 1)
    template = F.concat_ws("/", "host", F.array_join("segments", "/"))
    purity = (shapes.groupBy(template.alias("template")).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
              .withColumn("blocked", (F.col("bad") + PRIOR * overall) / (F.col("labelled") + PRIOR) >= IMPURE))
    return shapes.withColumn("template", template).join(purity.select("template", "blocked"), "template").select("host", "shape", "template", "blocked")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of each row.

    `labels` (page_id, bad) says which pages are bad (1) or not (0); of several labels of a page
    the worst counts, rows with nulls do not. Every page counts in the tree, ruled ones too.
    A null url, or one without `://`, has empty host and path and is judged like any other;
    without labels nothing but the rules blocks. Repeated rows give repeated rows, a null
    page_id stays null, other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    if labels is None:
        known = split.withColumn("bad", F.lit(None).cast("long"))
    else:
        worst = labels.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
        known = split.join(worst, "page_id", "left")
    blocked = templates(known).filter("blocked").select("host", "shape", "template", F.lit("block").alias("learned"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return (split.withColumn("shape", shape(F.col("path"))).join(blocked, ["host", "shape"], "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "learned", F.lit("allow")).alias("verdict"),
                    F.col("template").alias("blocked_template")))

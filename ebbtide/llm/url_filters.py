"""URL verdicts by rules and by a tree of path templates; DataFrame functions.

Rules (host and path prefix) decide first, the longest wins.  For all other URLs a template decides.
Per host the paths form a tree, built level by level on distinct paths with their counts:

* a segment that few of its siblings' URLs have is variable and becomes ``*``;
* among the segments that stay, those whose share of blocked URLs does not differ from that of all
  labelled siblings (a normal test) are statistically similar and merge into ``~``; those that differ
  to one side and not from each other merge into ``~block`` or ``~allow``; the rest, and the unlabelled
  ones, keep their names;
* paths deeper than ``MAX_DEPTH`` end in ``**``, whatever follows.

A template is rejected when its smoothed labelled purity, (blocked + 1) / (labelled + 2), reaches
``REJECT_AT``; a template without labels is allowed.  Labels are the verdicts of the rules unless
the caller has others.

Hot hosts: everything is keyed by host and path prefix, counts are combined before each shuffle, and
the joins of distinct paths with their segments are left to Spark's skew splitting.

Defined cases: a null url, or one without ``://``, has an empty host and path, which is a host like
any other; repeated rows weigh their number; an empty table gives no rows; other columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import ascii_lower
from ebbtide.operators.lineage import stored

MAX_DEPTH = 6
#: A segment stays if it has this many URLs and this share of its parent's.
LEAST_URLS, LEAST_SHARE = 3, 0.02
#: Least labelled URLs, and standard deviations, for a branch to count as different.
LEAST_LABELS, DIFFERENT = 5, 1.96
REJECT_AT = 0.8


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else null; rules are (``host/path``, verdict)."""
    rule = verdict = None
    for text, action in sorted(rules, key=lambda r: len(r[0]), reverse=True):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _difference(child: DataFrame, side: Column) -> DataFrame:
    """Branches with ``far``: 0, or the sign, if the blocked share differs from the pool of labelled
    siblings of the same side."""
    child = child.withColumn("side", F.coalesce(side, F.lit(0.0)).cast("double"))
    pool = child.groupBy("host", "prefix", "side").agg(
        F.sum(F.when(F.col("judged"), F.col("blocked"))).alias("pool_blocked"),
        F.sum(F.when(F.col("judged"), F.col("labelled"))).alias("pool"), F.count_if("judged").alias("branches"))
    p = F.try_divide(F.col("pool_blocked"), F.col("pool"))
    # The spread never falls to nothing, so equal branches are always similar.
    spread = F.sqrt(F.try_divide(p * (1 - p) + F.lit(1e-9), F.col("labelled")))
    gap = F.try_divide(F.col("blocked"), F.col("labelled")) - p
    far = F.when(F.col("judged") & (F.abs(gap) > DIFFERENT * spread), F.signum(gap)).otherwise(F.lit(0.0))
    return child.join(pool, ["host", "prefix", "side"]).withColumn("far", far)


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template) of distinct paths (host, path, n, blocked, allowed)."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rest = F.when(F.size(segments) > MAX_DEPTH, F.concat(F.slice(segments, 1, MAX_DEPTH), F.array(F.lit("**")))).otherwise(segments)
    rows = stored(paths.select("host", "path", "n", "blocked", "allowed", rest.alias("rest"), F.lit("").alias("prefix")))
    for level in range(MAX_DEPTH + 1):
        open_rows = rows.filter(F.size("rest") > level).withColumn("segment", F.get("rest", F.lit(level)))
        if open_rows.isEmpty():
            break
        child = open_rows.groupBy("host", "prefix", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")])
        parent = child.groupBy("host", "prefix").agg(F.sum("n").alias("all"))
        child = child.join(parent, ["host", "prefix"])
        child = child.withColumn("stays", (F.col("segment") == "**") | (F.col("n") >= LEAST_URLS) & (F.col("n") >= LEAST_SHARE * F.col("all")))
        labelled = F.col("blocked") + F.col("allowed")
        judged = F.col("stays") & (labelled >= LEAST_LABELS)
        child = child.withColumn("labelled", labelled).withColumn("judged", judged)
        # First against all labelled siblings, then against those that differ to the same side.
        first = _difference(child, F.lit(0))
        second = _difference(first.drop("pool", "pool_blocked", "branches"), F.signum("far"))
        alike = F.col("judged") & (F.col("branches") > 1) & (F.col("far") == 0)
        mark = F.when(F.col("side") > 0, "~block").when(F.col("side") < 0, "~allow").otherwise("~")
        child = second
        name = F.when(~F.col("stays"), "*").when(alike & (F.col("segment") != "**"), mark).otherwise(F.col("segment"))
        named = stored(child.select(F.col("host").alias("h"), F.col("prefix").alias("p"), F.col("segment").alias("s"), name.alias("as")))
        done = rows.filter(F.size("rest") <= level)
        moved = (open_rows.join(named, (F.col("host") == F.col("h")) & (F.col("prefix") == F.col("p")) & (F.col("segment") == F.col("s")))
                 .select("host", "path", "n", "blocked", "allowed", "rest", F.concat("prefix", F.lit("/"), "as").alias("prefix")))
        rows = stored(done.select(*moved.columns).union(moved))
    return rows.select("host", "path", "n", "blocked", "allowed", F.col("prefix").alias("template"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page (page_id, url).

    ``labels`` (host, path, blocked, allowed) replaces the rules' verdicts as labels.
    """
    host, path = parts(F.col("url").cast("string"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    distinct = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "block").alias("blocked"),
                                                F.count_if(F.col("by_rule") == "allow").alias("allowed"))
    if labels is not None:
        distinct = distinct.drop("blocked", "allowed").join(labels, ["host", "path"], "left").fillna(0, ["blocked", "allowed"])
    placed = stored(templates(distinct))
    purity = (F.sum("blocked") + 1) / (F.sum("blocked") + F.sum("allowed") + 2)
    rated = placed.groupBy("host", "template").agg(purity.alias("purity"))
    known = stored(placed.join(rated, ["host", "template"]).select(
        F.col("host").alias("h"), F.col("path").alias("p"), "template", "purity"))
    by_method = F.when(F.col("purity") >= REJECT_AT, "block").otherwise("allow")
    return (urls.join(known, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
            .select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), "template", "purity"))

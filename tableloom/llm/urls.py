"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes; DataFrame functions only.

A rule is a host and a path. Every URL is expanded into the expressions that a rule could be: the ends of its host at
label boundaries, each with the beginnings of its path. Rules and expressions meet in an equi-join on the first 32 bits
of their SHA-256; the whole digest confirms a meeting, and of the rules that fit a URL the longest decides.

Only expressions of a shape that some rule has (so many labels, so many path characters) are made, as no other can be
a rule; where rules have more shapes than `MAX_SHAPES`, all ends are made with all beginnings that are not longer than the
longest rule. Either way every rule that fits is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableloom.llm.common import col
from tableloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Hex digits of a digest by which expressions and rules meet.
PREFIX_DIGITS = 8
# Pairs (labels, path characters) that are listed one by one.
MAX_SHAPES = 256
VERDICTS = ("allow", "block")


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty for null and URLs without."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first `://` to the next `/`, `?`, `#` or the end, A-Z in lower case; empty where there is no `://`."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to the next `?`, `#` or the end; empty where there is no `://`."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # A host holds no slash and a path begins with one or is empty, so the line end keeps them apart.
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def _keyed_rules(rules: DataFrame) -> DataFrame:
    """(prefix, digest, rule, verdict): each (host, path) once; where it is both allowed and blocked, it is blocked."""
    host, path = F.translate(col("host"), UPPER, LOWER), F.coalesce(col("path"), F.lit(""))
    each = rules.where(col("host").isNotNull()).groupBy(host.alias("host"), path.alias("path")).agg(F.max("verdict").alias("verdict"))
    return each.select(
        F.left(_digest(F.col("host"), F.col("path")), F.lit(PREFIX_DIGITS)).alias("prefix"), _digest(F.col("host"), F.col("path")).alias("digest"),
        F.struct("host", "path").alias("rule"), "verdict")


def _expressions(rules: DataFrame) -> Column | None:
    """Array of (host, path) over columns `host` and `path`: all that a rule could be; None if there are no rules."""
    labels, chars = F.size(F.split(col("host"), r"\.")), F.length(F.coalesce(col("path"), F.lit("")))
    known = rules.where(col("host").isNotNull()).select(labels.alias("labels"), chars.alias("chars"))
    shapes = known.distinct().limit(MAX_SHAPES + 1).collect()
    if not shapes:
        return None
    end = lambda n: F.substring_index("host", ".", n)
    if len(shapes) <= MAX_SHAPES:
        # An end of more labels than the host has is the host, a beginning beyond the path's end is the path: left out.
        fits = lambda n, m: (F.size(F.split("host", r"\.")) >= n) & (F.length("path") >= m)
        one = [F.when(fits(s["labels"], s["chars"]), F.struct(end(-s["labels"]).alias("host"), F.substring("path", 1, s["chars"]).alias("path"))) for s in sorted(shapes)]
        return F.array_compact(F.array(*one))
    most = known.agg(F.max("labels").alias("labels"), F.max("chars").alias("chars")).first()
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(most["labels"]))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    begins = F.transform(F.sequence(F.lit(0), F.least(F.length("path"), F.lit(most["chars"]))), lambda m: F.substring(F.col("path"), F.lit(1), m))
    return F.flatten(F.transform(ends, lambda h: F.transform(begins, lambda p: F.struct(h.alias("host"), p.alias("path")))))


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row; `rules` is (host, path, verdict), `rule` the text of the rule that decides.

    A rule fits its host and all subdomains where the URL's path begins with the rule's. The longest that fits wins (host
    and path together; then the longer host). Where none fits, `rule` is null and the verdict is `default`. Rules with a
    null host fit nothing; a null path is the empty one; repeated rules count once, and block wins over allow. Null and
    malformed URLs have an empty host and path; repeated rows and null ids stay. An empty table gives none, an empty rule
    table the default for all. Other columns are not looked at.
    """
    if default not in VERDICTS:
        raise ValueError(f"default is one of {VERDICTS}")
    rows = df.select(col(id_col).alias("id"), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    expressions = _expressions(rules)
    if expressions is None:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    made = rows.select("*", F.explode_outer(expressions).alias("e"))
    made = made.withColumn("digest", _digest(F.col("e.host"), F.col("e.path"))).withColumn("prefix", F.left("digest", F.lit(PREFIX_DIGITS)))
    # Written, so that their size is known: few rules go to all executors, and expressions do not move. Where they are many,
    # a prefix has few of them, and the expressions of a hot host are split by the skew join.
    keyed = cut_lineage(_keyed_rules(rules).select("prefix", F.col("digest").alias("r_digest"), "rule", "verdict"))
    met = made.join(keyed, (made["prefix"] == keyed["prefix"]) & (F.col("digest") == F.col("r_digest")), "left")
    length = F.length("rule.host") + F.length("rule.path")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(length.alias("length"), F.length("rule.host").alias("host_length"), "rule", "verdict")))
    # The expressions of a row are made side by side, so they are one row again before they move.
    found = met.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return found.select(
        "id", "host", "path", F.concat("best.rule.host", "best.rule.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

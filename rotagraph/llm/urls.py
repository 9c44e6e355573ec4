"""URL filters: host-suffix and path-prefix expressions against rule digests.

Every URL is expanded into expressions ``host suffix + path prefix`` (suffixes at dots,
prefixes that end at a slash), of those depths that some rule has: others can't meet one,
and a long URL of nothing but slashes has no more expressions than the rules have shapes.
Expressions meet the rules by an equi-join on the first four bytes of their SHA-256
digests; a full digest then confirms each meeting, the remaining path text of the rule is
compared, and the longest rule wins.

Native: only DataFrame expressions. Distinct (host, path) pairs are expanded once, so a
host or page that holds a third of all rows costs one expansion, and the verdicts return
to the rows by an equi-join whose large partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rotagraph.session import written

#: Rules are broadcast up to so many rows; beyond that Spark shuffles both sides.
BROADCAST_RULES = 10_000


def _lowered(text):
    """A-Z lower-cased, nothing else."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def url_parts(url):
    """(host, path) of a URL column. Host: what follows the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the
    end. Null URLs and those without ``://`` have empty parts."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.split(rest, "[/?#]", 2)[0]
    path = F.split(F.substring(rest, F.length(host) + 1, F.length(rest)), "[?#]", 2)[0]
    return _lowered(host), path


def _occurrences(text, sign: str):
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _labels(host):
    return _occurrences(host, ".") + 1


def expressions(host, path, shapes: list[tuple[int, int]]):
    """Array of (suffix, prefix): the host's last so many labels with the path up to the
    so-manieth slash (0: ''), for each of ``shapes`` that the URL is large enough for."""

    def one(labels: int, slashes: int):
        fits = (F.col("_labels") >= labels) & (F.col("_slashes") >= slashes)
        prefix = F.concat(F.substring_index(path, "/", slashes), F.lit("/")) if slashes else F.lit("")
        return F.when(fits, F.struct(F.substring_index(host, ".", -labels).alias("suffix"), prefix.alias("prefix")))

    return F.filter(F.array(*(one(*x) for x in shapes)), lambda x: x.isNotNull())


def _expression(host, anchor):
    return F.concat(host, F.lit("\n"), anchor)


def _short(digest):
    return F.substring(digest, 1, 8)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) with digest columns. The anchor of a rule is its path up
    to the last slash; what follows is compared as text. Rows without a host are void;
    of equal (host, path) the verdict ``block`` wins."""
    host = _lowered("host")
    path = F.coalesce("path", F.lit(""))
    one = rules.where("host IS NOT NULL AND host != ''").groupBy(host.alias("r_host"), path.alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    one = one.withColumn("anchor", F.regexp_extract("r_path", r"^([\s\S]*/)?", 0))
    return one.withColumn("r_digest", F.sha2(_expression(F.col("r_host"), F.col("anchor")), 256)).withColumn("short", _short(F.col("r_digest")))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``rules``: (host, path, verdict). A rule fits its host and all subdomains if the path
    starts with the rule's path. Precedence: the longest rule text, then the longer host,
    then block before allow. Without a rule: ``rule`` null and ``verdict`` = ``default``.
    Null or malformed URLs have empty host and path and the default verdict; repeated rows
    each get a row; other columns of ``pages`` are not read, whatever their names.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    known = prepared_rules(rules)
    # one row a shape of rules, which are written by hand: a few, however many rules there are
    shapes = sorted(map(tuple, known.select(_labels("r_host"), _occurrences("anchor", "/")).distinct().collect()))
    keys = rows.where("host != ''").groupBy("host", "path").agg(F.lit(1).alias("one"))
    keys = keys.withColumns({"_labels": _labels("host"), "_slashes": _occurrences("path", "/")})
    expanded = (
        keys.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shapes or [(1 << 30, 0)])).alias("x"))
        .select("host", "path", F.sha2(_expression(F.col("x.suffix"), F.col("x.prefix")), 256).alias("digest"))
        .withColumn("short", _short(F.col("digest")))
    )
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    met = expanded.join(known, "short").where("digest = r_digest AND startswith(path, r_path)")
    rule = F.concat("r_host", "r_path")
    rank = F.struct(F.length(rule), F.length("r_host"), F.col("r_verdict"), rule.alias("rule"))
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias("verdict"))
    best = written(best, "url-verdicts")  # a plain table, so that a skewed join can be split
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

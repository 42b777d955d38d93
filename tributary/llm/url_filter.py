"""URL filters: pattern rules found by their rarest literal token, so that few rules run their regular expression on a URL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, small

#: Literal tokens of a URL or rule: runs of letters, digits and hyphens between separators.
TOKEN = "[^./?#&=:@,;!~%+_]+"
#: The token of rules without a literal one; every URL has it.
ANY = ""
RULE_DDL = "rule string, action string, pattern string, literal string"


def quoted(text: str) -> str:
    """``text`` as a Java regular expression of itself."""
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}-&~#" else c for c in text)


def host_rule(host: str, path: str, action: str) -> tuple[str, str, str, str]:
    """A rule for a host and its subdomains, where the path starts with ``path`` ("/" at least)."""
    return host + path, action, rf"^(?:[^/]*\.)?{quoted(host)}{quoted(path)}(?s:.*)", f"{host} {path.rsplit('/', 1)[0]}"


def glob_rule(glob: str, action: str) -> tuple[str, str, str, str]:
    """A rule for URLs (host and path) that match a glob with ``*``. A token beside a ``*`` may go on there, so it is no literal one."""
    pieces, literal = glob.split("*"), []
    for k, piece in enumerate(pieces):
        for token in re.finditer(TOKEN, piece):
            closed = (token.start() > 0 or k == 0) and (token.end() < len(piece) or k + 1 == len(pieces))
            literal += [token[0]] * closed
    return glob, action, "(?s)^" + ".*".join(map(quoted, pieces)) + "$", " ".join(literal)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules with the token that finds them: of a rule's literal tokens the one that fewest URLs hold (ties: the least)."""
    listed = rules.withColumn("token", F.explode_outer(F.filter(F.array_distinct(F.regexp_extract_all("literal", F.lit(f"({TOKEN[:-2]} ]+)"), 1)), lambda t: t != "")))
    held = urls.select(F.explode(tokens(F.concat("host", "path"))).alias("token"))
    held = held.join(small(listed.select("token").where("token IS NOT NULL").distinct()), "token").groupBy("token").count()
    rarity = F.struct(F.coalesce("count", F.lit(0)), F.coalesce("token", F.lit(ANY)))
    return listed.join(small(held), "token", "left").groupBy("rule", "action", "pattern").agg(
        F.min_by(F.coalesce("token", F.lit(ANY)), rarity).alias("token"))


def judged(pages: DataFrame, rules: DataFrame, scratch: Scratch, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Of the rules (rule, action, pattern, literal) whose pattern matches host and path the longest wins (ties: the least); its action
    is the verdict, ``default`` where none fits (rule is null then). A null url, or one without ``://``, has an empty host and path and
    fits no host rule; null ids and repeated rows are judged each; other columns are ignored; empty tables work.

    Equal host and path are judged once. Their tokens meet the rules' rarest tokens in a join that is broadcast only
    for few rules, and only those pairs run a regular expression; rules without a literal token meet every URL.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = scratch.save(rows.select("host", "path").distinct(), "urls")
    index = small(scratch.save(rule_index(rules, urls), "rules"))
    probes = urls.withColumn("token", F.explode(F.array_append(tokens(F.concat("host", "path")), F.lit(ANY))))
    hits = probes.join(index, "token").where(F.expr("concat(host, path) RLIKE pattern"))
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("size"), "rule", "action")).alias("best"))
    best = scratch.save(best, "best")
    return rows.join(small(best), ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))

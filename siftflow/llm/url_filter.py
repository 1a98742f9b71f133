"""URL filters: rules indexed by their rarest literal token.

A rule is a host (it fits all subdomains), a path prefix, an optional regular expression on the whole url with the words that
it needs, and a verdict. Its literal tokens are its host's labels, its path's segments and those words. How many urls hold each token is counted over all urls, and the
rule is indexed by its rarest one, so the tokens of a url fetch the few rules that may fit, and only those run their regular
expressions. Of fitting rules the longest (host and path together) wins, then the smaller (host, path).

Native: DataFrame functions only. Rules are the stated rule set; it is broadcast if it has at most BROADCAST_RULES rows.

A null url, or one without ://, has an empty host and path, and no rule fits it. Rows that repeat an id are judged each for
themselves, as are null ids. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftflow.llm.common import LOWER, UPPER, literal_rows

BROADCAST_RULES = 100_000
#: (host, path, url pattern or null, words that the pattern needs, with a space between them, verdict)
RULES = [
    ("com", "/", None, None, "allow"),
    ("example.com", "/en/", None, None, "block"),
    ("www.example.com", "/en/", None, None, "allow"),
    ("net", "/es/", None, None, "block"),
    ("net", "/fr/", None, None, "block"),
]
#: Where no rule for a host fits, a pattern of spam hosts may block; all else is allowed.
HOST = r"(?is)^(?:(?!://).)*://"
PATTERNS = [
    ("", "", HOST + r"([^/?#]*[.-])?spam([.-][^/?#]*)?([/?#]|\z)", "spam", "block"),
    ("", "", HOST + r"([^/?#]*\.)?(cheap|online|best)-pills([.-][^/?#]*)?([/?#]|\z)", "pills", "block"),
    ("", "", HOST + r"([^/?#]*[.-])?casino([.-][^/?#]*)?([/?#]|\z)", "casino", "block"),
]
RULE_SCHEMA = "host string, path string, pattern string, words string, verdict string"
OTHERWISE = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_tokens(host: Column) -> Column:
    return F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))


def path_tokens(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))


def word_tokens(host: Column) -> Column:
    """The parts of the host between dots and hyphens."""
    return F.transform(F.filter(F.split(host, "[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), x))


def rule_tokens(rules: DataFrame) -> DataFrame:
    """rule_id and each literal token: whole labels of the host, and the path's segments that a slash ends."""
    ended = F.regexp_extract(F.col("path"), "^(.*/)", 1)
    words = F.transform(F.filter(F.split(F.coalesce("words", F.lit("")), " "), lambda x: x != ""), lambda x: F.concat(F.lit("w:"), F.lower(x)))
    return rules.select("rule_id", F.explode(F.array_distinct(F.concat(host_tokens(F.col("host")), path_tokens(ended), words))).alias("token"))


def url_verdicts(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the rule that won; null for one without either, or none), verdict."""
    spark = pages.sparkSession
    rules = literal_rows(spark, RULES + PATTERNS, RULE_SCHEMA) if rules is None else rules
    rules = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "pattern", "words", "verdict")
    rules = rules.withColumn("rule_id", F.xxhash64("host", "path", "pattern", "words", "verdict"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    tokens = F.array_distinct(F.concat(host_tokens(F.col("host")), path_tokens(F.col("path")), word_tokens(F.col("host"))))
    literal = rule_tokens(rules)
    used = literal.select("token").distinct()
    n = rules.count()
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_RULES else (lambda df: df)
    often = urls.select(F.explode(tokens).alias("token")).join(small(used), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    rarest = literal.join(often, "token", "left").withColumn("r", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.coalesce("df", F.lit(0)), "token"))).where("r = 1").select("rule_id", "token")
    # a rule without a literal token is fetched by every url, through the empty token
    index = rules.join(rarest, "rule_id", "left").withColumn("token", F.coalesce("token", F.lit(""))).distinct()
    index = index.select("token", F.struct((F.length("host") + F.length("path")).alias("size"), "host", "path", "pattern", "verdict").alias("r"))
    # the rules of one token are one row, so each token of a url meets one row, and partial aggregation leaves one row a page
    grouped = index.groupBy("token").agg(F.collect_list("r").alias("rules"))
    asked = urls.withColumn("token", F.explode(F.concat(F.array(F.lit("")), tokens))).join(small(grouped), "token", "left")

    def fits(r: Column) -> Column:
        on_host = (r.host == "") | (F.col("host") == r.host) | F.col("host").endswith(F.concat(F.lit("."), r.host))
        return (F.col("host") != "") & F.startswith("path", r.path) & on_host & (r.pattern.isNull() | F.coalesce(F.rlike("url", r.pattern), F.lit(False)))

    best = F.array_max(F.transform(F.filter("rules", fits), lambda r: F.struct(r["size"].alias("size"), r.host.alias("host"), r.path.alias("path"), r.verdict.alias("verdict"))))
    judged = asked.withColumn("best", F.when(F.col("rules").isNotNull(), best)).groupBy("page_id", "url", "host", "path").agg(F.max("best").alias("best"), F.count(F.when(F.col("token") == "", 1)).alias("rows"))
    each = judged.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("page_id", "host", "path", F.when(F.col("best.size") > 0, F.concat("best.host", "best.path")).alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))

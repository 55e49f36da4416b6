"""URL filter: sort-merge range join of urls with nested host and path rules. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesalith.llm._common import ascii_lower

#: (rule, verdict); a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Sorts before every character of a key; ends the host part, so that a host is never the prefix of a longer label.
END = "\x01"
#: Keys are compared as UTF-8 bytes; this byte is in none of them and sorts after all.
TOP = b"\xff"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_table(spark, rules=RULES) -> DataFrame:
    """(rule, verdict, key): key is the reversed host, END and the path; a url's key at that host level starts with it."""
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in dict(rules).items()]
    df = spark.range(0, 1, 1, 1).select(F.explode(F.array(*rows).cast("array<struct<rule:string,verdict:string>>")).alias("r")).select("r.*")
    at = F.instr("rule", "/")
    host = F.when(at > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule"))
    path = F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    return df.select("rule", "verdict", F.size(F.split(host, "\\.")).alias("depth"), F.concat(_reversed_host(F.split(ascii_lower(host), "\\.")), F.lit(END), path).alias("key"))


def sweep_events(rules: DataFrame) -> DataFrame:
    """Start and end of each rule's interval [key, key + TOP), each with the innermost rule that holds from there on.

    The rule around a rule is its longest proper prefix among the rules; it is found by an equi-join on prefixes, so
    the stack of active rules is kept as a chain of parents.
    """
    ups = rules.select("key", "depth", F.explode(F.expr("transform(sequence(1, greatest(length(key) - 1, 1)), i -> substring(key, 1, i))")).alias("up"))
    parents = (ups.where("up <> key").join(rules.select(F.col("key").alias("up"), F.col("rule").alias("p_rule"), F.col("verdict").alias("p_verdict")), "up")
               .groupBy("key").agg(F.max_by(F.struct("p_rule", "p_verdict"), F.length("up")).alias("p")))
    top = rules.join(parents, "key", "left")
    start = top.select(F.col("key").cast("binary").alias("at"), F.lit(1).alias("kind"), F.length("key").alias("tie"), F.struct("rule", "verdict").alias("state"))
    end = top.select(F.concat(F.col("key").cast("binary"), F.lit(bytearray(TOP))).alias("at"), F.lit(0).alias("kind"), (-F.length("key")).alias("tie"),
                     F.struct(F.col("p.p_rule").alias("rule"), F.col("p.p_verdict").alias("verdict")).alias("state"))
    return start.unionByName(end)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, default: str = "allow", salts: int | None = None) -> DataFrame:
    """Judge every url: (page id, host, path, rule, verdict).

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest rule (characters)
    wins, of equally long ones the one with the longer host. Without a fitting rule, rule is null and the verdict is
    `default`. Null urls and urls without :// have an empty host and path, which no rule fits. Equal rows are judged
    once and given back as often as they came; a null id stays null. Other columns are not read.

    Each url has a key per level of its host (a.b.c: c, c.b, c.b.a) that a rule's host can have, and a rule is an
    interval of keys. Keys and interval ends are sorted together and swept; the innermost active rule is the last state
    seen. Rows are dealt by a hash of id and url over `salts` tasks (by default as many as shuffle partitions), and the
    interval ends go to each of them, so no host, however frequent, meets in one task.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = {k: v for k, v in dict(rules).items() if k}
    depths = sorted({k.split("/")[0].count(".") + 1 for k in rules})
    host, path = host_path(F.col("url"))
    rows = (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count("*").alias("n"))
            .withColumns({"host": host, "path": path}))
    if not rules:
        judged = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    else:
        labels = F.split("host", "\\.")
        levels = F.filter(F.array(*map(F.lit, depths)), lambda d: d <= F.size(labels))
        # depth 0 keeps urls whose host has no level of a rule
        keyed = (rows.select("id", "url", "n", "host", "path", F.explode(F.concat(F.array(F.lit(0)), levels)).alias("depth"))
                 .withColumn("at", F.when(F.col("depth") > 0, F.concat(F.array_join(F.slice(F.reverse(F.split("host", "\\.")), 1, F.greatest("depth", F.lit(1))), "."), F.lit(END), "path")).otherwise(F.lit("")).cast("binary")))
        events = sweep_events(rule_table(spark, tuple(rules.items())))
        none = F.lit(None)
        points = keyed.select((F.pmod(F.xxhash64("id", "url"), F.lit(salts))).cast("int").alias("salt"), "at", F.lit(2).alias("kind"), F.lit(0).alias("tie"),
                              none.cast("struct<rule:string,verdict:string>").alias("state"), F.struct("id", "url", "n", "host", "path", "depth").alias("row"))
        marks = events.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "at", "kind", "tie", "state", none.cast(points.schema["row"].dataType).alias("row"))
        order = Window.partitionBy("salt").orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
        swept = (points.unionByName(marks).withColumn("top", F.last("state", ignorenulls=True).over(order)).where("row is not null")
                 .select("row.*", "top"))
        fits = F.when(F.col("top.rule").isNotNull() & (F.col("depth") > 0), F.struct(F.length("top.rule").alias("len"), "depth", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")))
        judged = (swept.groupBy("id", "url", "n", "host", "path").agg(F.max(fits).alias("best"))
                  .withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))}))
    return (judged.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_"))
            .drop("_"))


def op10(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
WITH r(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT n, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
m AS (SELECT q.n, r.rule, r.verdict, row_number() OVER (PARTITION BY q.n ORDER BY length(r.rule) DESC, length(r.host) DESC) AS k
  FROM q JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM q LEFT JOIN m ON m.n = q.n AND m.k = 1
"""

"""URL filters: allow and block rules, and a character language-model ratio for the rest.

Two Markov models over characters, one for accepted and one for rejected URLs, are counted
from the URLs that the rules judge, over the whole URL: scheme, host, path, query and
fragment. Each mixes contexts of two, one and no characters by
Witten-Bell weights, so the order follows what was seen. Characters fall into a fixed
alphabet, hence the table of log ratios has a fixed number of entries; it reaches the rows
as a constant. A URL's score is the sum of its characters' log ratios divided by its
length; the threshold is the one with the least balanced error on a fifth of the judged
URLs that was not counted. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronopanel.llm.common import ascii_lower, columns

#: The rules of the registered query, as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Symbols: 0 before the start, 26 letters, digits, marks, other ASCII, the rest.
MARKS = "/.-_%?=&#:"
OTHER = 28 + len(MARKS)
SYMBOLS = OTHER + 2
#: Log ratios are whole millionths; scores are binned by hundredths.
UNIT, BIN = 1_000_000, 10_000


def host(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule(rules=RULES) -> Column:
    """The longest rule whose host is the URL's or above it and whose path begins the URL's, as
    (rule, verdict); null if none fits. Of equally long ones a blocking one, then the first by name."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        own, _, start = name.partition("/")
        fits = (F.col("host") == own) | F.col("host").endswith("." + own)
        found = F.when(fits & F.col("path").startswith("/" + start), F.struct(F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def symbol(char: str) -> int:
    """The alphabet's number of an ASCII character, whatever its case."""
    low = char.lower()
    if "a" <= low <= "z":
        return ord(low) - 96
    return 27 if char.isdigit() else 28 + MARKS.index(char) if char in MARKS else OTHER


def symbols(text: Column) -> Column:
    """The alphabet's numbers of a text's characters."""
    numbers = F.array(*[F.lit(symbol(chr(k))) for k in range(128)])
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.coalesce(F.get(numbers, F.ascii(x)), F.lit(OTHER + 1)))


def triples(sym: Column) -> Column:
    """Each symbol with the two before it, as one number; before the start are zeros."""
    led = F.concat(F.array(F.lit(0), F.lit(0)), sym)
    return F.transform(sym, lambda x, i: F.get(led, i) * SYMBOLS * SYMBOLS + F.get(led, i + 1) * SYMBOLS + x)


def kept_back(id: Column) -> Column:
    """Whether a row is kept for the threshold: a fifth, by a hash of its id; a null id is not."""
    hashed = F.conv(F.substring(F.md5(id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(hashed, F.lit(5)) == 0, F.lit(False))


def log_ratios(judged: DataFrame) -> DataFrame:
    """(code, value) for every triple: log P(accepted) - log P(rejected), from (verdict, codes)."""
    seen = judged.select("verdict", F.explode("codes").alias("code")).groupBy("verdict", "code").agg(F.count(F.lit(1)).alias("n"))
    grid = judged.sparkSession.range(SYMBOLS**3).select(F.col("id").alias("code"))
    both = grid.withColumn("verdict", F.explode(F.array(F.lit("allow"), F.lit("block"))))
    cells = both.join(seen, ["verdict", "code"], "left").select(
        "verdict", "code", F.coalesce("n", F.lit(0)).alias("n3"),
        F.floor(F.col("code") / SYMBOLS**2).alias("a"), F.floor(F.col("code") / SYMBOLS % SYMBOLS).alias("b"), (F.col("code") % SYMBOLS).alias("c"),
    )
    kinds = lambda n: F.sum((F.col(n) > 0).cast("long"))
    two = cells.groupBy("verdict", "b", "c").agg(F.sum("n3").alias("n2"))
    one = two.groupBy("verdict", "c").agg(F.sum("n2").alias("n1"))
    none = one.groupBy("verdict").agg(F.sum("n1").alias("n0"), kinds("n1").alias("t0"))
    of_b = two.groupBy("verdict", "b").agg(F.sum("n2").alias("nb"), kinds("n2").alias("tb"))
    of_ab = cells.groupBy("verdict", "a", "b").agg(F.sum("n3").alias("nab"), kinds("n3").alias("tab"))
    mixed = lambda n, total, t, low: F.when(F.col(total) > 0, (F.col(n) + F.col(t) * low) / (F.col(total) + F.col(t))).otherwise(low)
    p = mixed("n1", "n0", "t0", F.lit(1.0 / SYMBOLS))
    p = mixed("n3", "nab", "tab", mixed("n2", "nb", "tb", p))
    wide = cells.join(two, ["verdict", "b", "c"]).join(one, ["verdict", "c"]).join(none, "verdict").join(of_b, ["verdict", "b"]).join(of_ab, ["verdict", "a", "b"])
    side = lambda v: F.sum(F.when(F.col("verdict") == v, F.ln(p)))
    return wide.groupBy("code").agg(F.round((side("allow") - side("block")) * UNIT).cast("long").alias("value"))


def judge(pages: DataFrame, rules=RULES, id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score of every row.

    A null URL or one without `://` has empty host and path, so no rule fits it. The models
    read the whole URL as it is, with or without `://`; a null or empty one has score 0,
    which is held against the threshold like any other. Where the rules accept or reject no
    URL the threshold is 0. Ids of any type are taken, null ones too. Repeated rows are
    judged each, an empty table gives an empty one, other columns play no part.
    """
    rows = columns(pages, page_id=id, url=url)
    rows = rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("by", rule(rules)).withColumn("codes", triples(symbols(F.coalesce("url", F.lit("")))))
    back = kept_back(F.col("page_id"))
    judged = rows.where("by IS NOT NULL").select("codes", F.col("by.verdict").alias("verdict"), back.alias("back"))
    ratios = log_ratios(judged.where(~F.col("back")))
    # SYMBOLS ** 3 numbers whatever the input, as a constant of the plan
    values = [str(r["value"]) for r in ratios.orderBy("code").collect()]
    table = F.split(F.lit(",".join(values)), ",").cast("array<bigint>")

    def score(codes: Column) -> Column:
        total = F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + F.get(table, x.cast("int")))
        return F.when(F.size(codes) > 0, total / F.size(codes)).otherwise(0.0)

    bins = judged.where("back").select("verdict", F.floor(score(F.col("codes")) / BIN).alias("bin"))
    bins = bins.groupBy("bin").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    # as many bins as scores between the extremes of the table, whatever the rows
    below, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    missed = F.try_divide(F.coalesce(F.sum("good").over(below), F.lit(0)), F.sum("good").over(all_))
    passed = 1 - F.try_divide(F.coalesce(F.sum("bad").over(below), F.lit(0)), F.sum("bad").over(all_))
    edge = bins.select("bin", (missed + passed).alias("error")).where("error IS NOT NULL")
    edge = edge.agg(F.min(F.struct(F.round("error", 12), "bin"))["bin"].alias("edge")).first()["edge"] or 0
    rows = rows.withColumn("points", score(F.col("codes")))
    ratio = F.when(F.floor(F.col("points") / BIN) >= edge, "allow").otherwise("block")
    return rows.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce(F.col("by.verdict"), ratio).alias("verdict"), (F.col("points") / UNIT).alias("score"))


#: The same in DuckDB's SQL.
SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rows AS (
  SELECT row_number() OVER () AS r, page_id, url, host, path,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule,
    translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM parts),
said AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said, coalesce(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0, false) AS back FROM rows),
chars AS (SELECT r, said, back, unnest(range(1, length(t) + 1)) AS i, t FROM said),
syms AS (SELECT r, said, back, i, CASE WHEN ch BETWEEN 'a' AND 'z' THEN unicode(ch) - 96 WHEN ch BETWEEN '0' AND '9' THEN 27
    WHEN instr('{MARKS}', ch) > 0 THEN 27 + instr('{MARKS}', ch) WHEN unicode(ch) < 128 THEN {OTHER} ELSE {OTHER + 1} END AS s
  FROM (SELECT r, said, back, i, t[i] AS ch FROM chars)),
codes AS (SELECT r, said, back, coalesce(lag(s, 2) OVER w, 0) * {SYMBOLS**2} + coalesce(lag(s) OVER w, 0) * {SYMBOLS} + s AS code FROM syms WINDOW w AS (PARTITION BY r ORDER BY i)),
cells AS (
  SELECT v.verdict, g.code, coalesce(n, 0) AS n3, g.code // {SYMBOLS**2} AS a, g.code // {SYMBOLS} % {SYMBOLS} AS b, g.code % {SYMBOLS} AS c
  FROM (SELECT unnest(range(0, {SYMBOLS**3})) AS code) g CROSS JOIN (VALUES ('allow'), ('block')) v(verdict)
  LEFT JOIN (SELECT said, code, count(*) AS n FROM codes WHERE said IS NOT NULL AND NOT back GROUP BY ALL) x ON x.said = v.verdict AND x.code = g.code),
two AS (SELECT verdict, b, c, sum(n3) AS n2 FROM cells GROUP BY ALL),
one AS (SELECT verdict, c, sum(n2) AS n1 FROM two GROUP BY ALL),
none AS (SELECT verdict, sum(n1) AS n0, count(*) FILTER (n1 > 0) AS t0 FROM one GROUP BY ALL),
ofb AS (SELECT verdict, b, sum(n2) AS nb, count(*) FILTER (n2 > 0) AS tb FROM two GROUP BY ALL),
ofab AS (SELECT verdict, a, b, sum(n3) AS nab, count(*) FILTER (n3 > 0) AS tab FROM cells GROUP BY ALL),
low AS (SELECT *, CASE WHEN n0 > 0 THEN (n1 + t0 * CAST({1.0 / SYMBOLS!r} AS DOUBLE)) / (n0 + t0) ELSE CAST({1.0 / SYMBOLS!r} AS DOUBLE) END AS p0
  FROM cells JOIN two USING (verdict, b, c) JOIN one USING (verdict, c) JOIN none USING (verdict) JOIN ofb USING (verdict, b) JOIN ofab USING (verdict, a, b)),
mid AS (SELECT *, CASE WHEN nb > 0 THEN (n2 + tb * p0) / (nb + tb) ELSE p0 END AS p1 FROM low),
high AS (SELECT verdict, code, CASE WHEN nab > 0 THEN (n3 + tab * p1) / (nab + tab) ELSE p1 END AS p FROM mid),
ratio AS (SELECT code, CAST(round((sum(ln(p)) FILTER (verdict = 'allow') - sum(ln(p)) FILTER (verdict = 'block')) * {UNIT}) AS BIGINT) AS value FROM high GROUP BY code),
points AS (SELECT r, CAST(sum(value) AS DOUBLE) / count(*) AS points FROM codes JOIN ratio USING (code) GROUP BY r),
scored AS (SELECT said.*, coalesce(points, 0.0) AS points, floor(coalesce(points, 0.0) / {BIN}) AS bin FROM said LEFT JOIN points USING (r)),
bins AS (SELECT bin, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM scored WHERE said IS NOT NULL AND back GROUP BY bin),
edges AS (SELECT bin, coalesce(sum(good) OVER w, 0) / nullif(sum(good) OVER (), 0) + 1 - coalesce(sum(bad) OVER w, 0) / nullif(sum(bad) OVER (), 0) AS error
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
edge AS (SELECT coalesce((SELECT bin FROM edges WHERE error IS NOT NULL ORDER BY round(error, 12), bin LIMIT 1), 0) AS edge)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bin >= edge THEN 'allow' ELSE 'block' END) AS verdict
FROM scored CROSS JOIN edge
"""

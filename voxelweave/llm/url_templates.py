"""URL filter: fixed rules first, then path templates judged by labelled purity.

Paths become trees per host. Segments with digits or long hexadecimal runs become wildcards. At every node the labels decide which
children are generalised: a child is held against all its siblings together (two-proportion test of rates smoothed towards the
node's); those that do not differ, unlabelled ones included, become one wildcard, whatever their number. Children that stand out
keep their names, and of these, ones whose rates do not differ (in the order of their rates) are merged into one branch ``*k``. A
template is rejected if its share of good labelled pages, smoothed towards its host's and that towards all pages', falls below
``purity``.

The walk goes down as long as a node has ``min_labelled`` labelled pages below it; with fewer no child can stand out (11 is the
least number with the default smoothing and z), and the rest of the path is ``**``. So depth and width follow from the data.

Work is done on distinct (host, shape) pairs with counts: a host with a third of all pages is a few rows after a map-side sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelweave.llm.common import sized_text, stored

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"[0-9]+|(?<![a-z0-9])[0-9a-f]{8,}(?![a-z0-9])"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and begins the path; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/")
        fits = F.endswith(F.concat(F.lit("."), host_), F.lit("." + text[:at])) & F.startswith(path_, F.lit(text[at:]))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shape(path_: Column) -> Column:
    """Generalised segments."""
    return F.array_join(F.transform(F.array_remove(F.split(path_, "/"), ""), lambda s: F.regexp_replace(s, VARIABLE, "*")), "/")


def _step(active: DataFrame, depth: int, min_labelled: int, a: Column, z: float) -> DataFrame:
    """Rows of ``active`` with one more level of their template, and ``open``: whether the walk goes on below it."""
    known = active.withColumn("segment", F.get("segments", F.lit(depth)))
    node = ["host", "template"]
    children = known.where("segment is not null").groupBy(*node, "segment").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    children = stored(children, "children")
    whole = children.groupBy(*node).agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"), F.count("*").alias("width"))
    whole = stored(whole.where(F.col("all_n") >= min_labelled).join(known.groupBy(*node).agg(F.first("prior").alias("prior")), node), "nodes")
    usual = (F.col("all_b") + a * F.col("prior")) / (F.col("all_n") + a)
    rated = children.join(sized_text(whole), node).withColumn("usual", usual).withColumn("rate", (F.col("b") + a * F.col("usual")) / (F.col("n") + a))
    rest = (F.col("all_b") - F.col("b") + a * F.col("usual")) / (F.col("all_n") - F.col("n") + a)
    pooled = (F.col("all_b") + 2 * a * F.col("usual")) / (F.col("all_n") + 2 * a)
    error = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("n") + a) + 1 / (F.col("all_n") - F.col("n") + a)))
    rated = rated.withColumn("apart", (error > 0) & (F.abs(F.col("rate") - rest) >= F.lit(z) * error))

    by_rate = Window.partitionBy(*node).orderBy("rate", "segment")
    before = rated.where("apart and width > 1").select("*", *(F.lag(c).over(by_rate).alias(c + "0") for c in ("n", "b", "rate")))
    both = (F.col("b") + F.col("b0") + 2 * a * F.col("usual")) / (F.col("n") + F.col("n0") + 2 * a)
    gap = F.sqrt(both * (1 - both) * (1 / (F.col("n") + a) + 1 / (F.col("n0") + a)))
    differs = F.coalesce((F.col("rate") - F.col("rate0") >= F.lit(z) * gap) & (gap > 0), F.lit(False))
    branch = before.select(*node, "segment", F.sum(differs.cast("int")).over(by_rate.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("branch"))
    alone = branch.groupBy(*node, "branch").agg((F.count("*") == 1).alias("alone"))
    outstanding = branch.join(alone, [*node, "branch"]).select(*node, "segment", F.when(F.col("alone"), F.col("segment")).otherwise(F.concat(F.lit("*"), F.col("branch").cast("string"))).alias("label"))
    usual_ones = rated.where("not apart or width = 1").select(*node, "segment", F.when(F.col("width") == 1, F.col("segment")).otherwise("*").alias("label"))
    labels = stored(outstanding.unionByName(usual_ones), "labels")
    named = known.join(sized_text(labels), [*node, "segment"], "left")
    grown = F.when(F.col("segment").isNull(), F.col("template")).when(F.col("label").isNull(), F.concat("template", F.lit("/**"))).otherwise(F.concat("template", F.lit("/"), "label"))
    return stored(named.withColumn("open", F.col("label").isNotNull()).withColumn("template", grown).drop("label", "segment"), "grown")


def templates(shapes: DataFrame, smoothing: float = 10.0, z: float = 1.96, min_labelled: int = 11) -> DataFrame:
    """(host, shape, template, good_share) from rows (host, shape, labelled, bad)."""
    total = shapes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("prior")).first()["prior"]
    segments = F.when(F.col("shape") != "", F.split("shape", "/")).otherwise(F.array().cast("array<string>"))
    active = shapes.withColumns({"prior": F.lit(float(total)), "segments": segments, "template": F.lit("")})
    a, depth, done = F.lit(float(smoothing)), 0, []
    while True:
        grown = _step(active, depth, min_labelled, a, z)
        done.append(grown.where("not open").drop("open", "segments"))
        active, depth = grown.where("open").drop("open"), depth + 1
        if active.isEmpty():
            break
    known = done[0]
    for level in done[1:]:
        known = known.unionByName(level)
    known = stored(known, "templates")
    hosts = known.groupBy("host").agg(F.sum("labelled").alias("host_n"), F.sum("bad").alias("host_b"), F.first("prior").alias("prior"))
    hosts = hosts.select("host", ((F.col("host_n") - F.col("host_b") + a * (1 - F.col("prior"))) / (F.col("host_n") + a)).alias("host_share"))
    paths = known.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).join(hosts, "host")
    judged = stored(paths.select("host", "template", ((F.col("n") - F.col("b") + a * F.col("host_share")) / (F.col("n") + a)).alias("good_share")), "judged")
    return known.select("host", "template", "shape").join(sized_text(judged), ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, purity: float = 0.6, **how) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, template, good_share), one for each row of ``pages``.

    A page is labelled by the row of ``labels`` (doc_id, quality) with its id: quality 0 is bad; of several rows the worst
    counts. Only page_id and url are read, so further columns may have any name. A null url or one without ``://`` has
    empty host and path, no rule and the template of that empty host. A null page_id has no label. Repeated rows are
    repeated pages. Without labels every template is as good as another and is allowed. An empty table gives no rows. Urls of any
    length are read whole; the walk takes one level for each segment down to which labelled pages reach.
    """
    parsed = stored(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("shape", shape(F.col("path"))), "parsed")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = parsed.join(known, F.col("page_id") == F.col("doc_id"), "left")
    shapes = stored(labelled.groupBy("host", "shape").agg(F.count("quality").alias("labelled"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")), "shapes")
    found = stored(templates(shapes, **how), "found")
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("good_share") < purity, "block").otherwise("allow")
    return parsed.join(sized_text(found), ["host", "shape"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, learned).alias("verdict"), "template", F.round("good_share", 9).alias("good_share"),
    )


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES, purity: float = 0.6, levels: int = 8, min_labelled: int = 11, a: float = 10.0, z: float = 1.96) -> str:
    """SQL of ``judge`` for tables whose labelled paths have fewer than ``levels`` segments; deeper ones give an error, not other rows."""
    rule = verdict = "NULL"
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/")
        fits = f"suffix('.' || host, '.{text[:at]}') AND prefix(path, '{text[at:]}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    d = f"CAST({a} AS DOUBLE)"
    walk = []
    for k in range(levels):
        walk.append(f"""
s{k} AS MATERIALIZED (SELECT *, CASE WHEN open THEN segments[{k + 1}] END AS segment FROM t{k}),
c{k} AS MATERIALIZED (SELECT host, template, segment, sum(labelled) AS n, sum(bad) AS b, first(prior) AS prior FROM s{k} WHERE segment IS NOT NULL GROUP BY ALL),
n{k} AS (SELECT *, sum(n) OVER w AS all_n, sum(b) OVER w AS all_b, count(*) OVER w AS width FROM c{k} WINDOW w AS (PARTITION BY host, template)),
u{k} AS (SELECT *, (all_b + {d} * prior) / (all_n + {d}) AS usual FROM n{k} WHERE all_n >= {min_labelled}),
r{k} AS (SELECT *, (b + {d} * usual) / (n + {d}) AS rate, (all_b - b + {d} * usual) / (all_n - n + {d}) AS rest, (all_b + 2 * {d} * usual) / (all_n + 2 * {d}) AS pooled FROM u{k}),
e{k} AS (SELECT *, sqrt(pooled * (1 - pooled) * (1 / (n + {d}) + 1 / (all_n - n + {d}))) AS err FROM r{k}),
x{k} AS MATERIALIZED (SELECT *, err > 0 AND abs(rate - rest) >= {z}::DOUBLE * err AS apart FROM e{k}),
l{k} AS (SELECT *, lag(n) OVER w AS n0, lag(b) OVER w AS b0, lag(rate) OVER w AS rate0 FROM x{k} WHERE apart AND width > 1 WINDOW w AS (PARTITION BY host, template ORDER BY rate, segment)),
p{k} AS (SELECT *, (b + b0 + 2 * {d} * usual) / (n + n0 + 2 * {d}) AS joint FROM l{k}),
f{k} AS (SELECT *, sqrt(joint * (1 - joint) * (1 / (n + {d}) + 1 / (n0 + {d}))) AS gap FROM p{k}),
b{k} AS (SELECT *, sum(CASE WHEN gap > 0 AND rate - rate0 >= {z}::DOUBLE * gap THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY rate, segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS branch FROM f{k}),
g{k} AS MATERIALIZED (SELECT host, template, segment, CASE WHEN count(*) OVER (PARTITION BY host, template, branch) = 1 THEN segment ELSE '*' || branch END AS label FROM b{k}
  UNION ALL SELECT host, template, segment, CASE WHEN width = 1 THEN segment ELSE '*' END FROM x{k} WHERE NOT apart OR width = 1),
t{k + 1} AS MATERIALIZED (SELECT host, shape, segments, labelled, bad, prior, open AND label IS NOT NULL AS open,
  template || CASE WHEN s.segment IS NULL THEN '' WHEN label IS NULL THEN '/**' ELSE '/' || label END AS template FROM s{k} s LEFT JOIN g{k} USING (host, template, segment))""")
    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
v AS (SELECT *, list_filter(list_transform(string_split(path, '/'), lambda s: regexp_replace(s, '[0-9]+|[0-9a-f]{{8,}}', '*', 'g')), lambda s: s <> '') AS seg FROM u),
pp AS MATERIALIZED (SELECT page_id, host, path, array_to_string(seg, '/') AS shape FROM v),
lb AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sh AS MATERIALIZED (SELECT host, shape, count(quality) AS labelled, count(*) FILTER (WHERE quality = 0) AS bad FROM pp LEFT JOIN lb ON page_id = doc_id GROUP BY host, shape),
t0 AS MATERIALIZED (SELECT host, shape, CASE WHEN shape <> '' THEN string_split(shape, '/') ELSE [] END AS segments, labelled, bad,
  (SELECT CASE WHEN sum(labelled) > 0 THEN CAST(sum(bad) AS DOUBLE) / CAST(sum(labelled) AS DOUBLE) ELSE 0 END FROM sh) AS prior, true AS open, '' AS template FROM sh),
{",".join(walk)},
z AS MATERIALIZED (SELECT *, CASE WHEN open THEN error('more levels') ELSE '' END AS checked FROM t{levels}),
hs AS (SELECT host, (sum(labelled) - sum(bad) + {d} * (1 - first(prior))) / (sum(labelled) + {d}) AS host_share FROM z GROUP BY host),
js AS (SELECT host, template, (n - b + {d} * host_share) / (n + {d}) AS good_share FROM (SELECT host, template || min(checked) AS template, sum(labelled) AS n, sum(bad) AS b FROM z GROUP BY host, template) JOIN hs USING (host))
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN good_share < {purity} THEN 'block' ELSE 'allow' END) AS verdict, template, round(good_share, 9) AS good_share
FROM pp JOIN z USING (host, shape) JOIN js USING (host, template)
"""

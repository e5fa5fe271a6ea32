"""Operator 8: URL verdicts from rules and a path-template tree (native).

Rules come first: the longest one whose host is the URL's host or a parent of it
and whose path starts the URL's path. Pages that a rule decides are the labelled
ones; the others are judged by the tree that those teach.

Per host, digit runs of a path become ``{n}`` and the segments, at every depth,
either stay or become the wildcard ``*``: of a node's children those with less
than one ``SHARE``-th of its pages do, where there are ``CHILDREN`` such at least,
so a busy child stays apart from a crowd of rare ones and a table of another size
has the same templates. Nodes are exact for the first ``LEVELS`` segments; below
those, the node of a segment is its branch, the path's number of segments and the
place. Sibling branches (equal but for the first segment) whose shares of blocked
pages do not differ significantly (two-proportion z test) merge; one without
labels differs from none and merges too.

The purity of a template is smoothed toward wider evidence step by step: it is
(blocked + SMOOTH * next) / (labelled + SMOOTH) over the merged siblings, then
over its host, and at last the share of blocked pages among all labelled ones. A
branch that stands apart is smoothed toward its siblings. A template is rejected
when its purity reaches ``REJECT``; what other hosts do under the same template
does not count, so a host without labels is judged by the common share alone.

All learning works on counts per (host, shape), grouped before any shuffle, so a
host with a third of the pages is no heavier than its number of shapes. The
verdicts go back to the pages by one join, whose strategy follows measured sizes.

Defined results: a null URL and one without ``://`` have an empty host and path,
no rule, and the verdict of that template; repeated rows get equal results; an
empty table gives no rows; columns other than ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import stash, table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
SHARE, CHILDREN, LEVELS = 16, 8, 3
Z, SMOOTH, REJECT = 1.96, 2.0, 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, of a URL."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule, like ``net/``, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _rare(children: DataFrame, node: list[str]) -> DataFrame:
    """(*node, child) of the children that become wildcards; ``children(*node, child, m)``."""
    total = stash(children.groupBy(*node).agg(F.sum("m").alias("total")), "nodes")
    rare = stash(children.join(total, node).where(F.col("m") * SHARE < F.col("total")).select(*node, "child"), "rare")
    crowd = rare.groupBy(*node).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= CHILDREN).select(*node)
    return rare.join(stash(crowd, "crowds"), node).withColumn("wild", F.lit(True))


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes(host, shape, n, ...)`` with ``template``."""
    parts = F.split("shape", F.lit("/"))
    tree = shapes.withColumn("segments", F.slice(parts, 2, F.size(parts))).withColumn("template", F.lit(""))
    step = lambda wild, child: F.concat(F.lit("/"), F.when(wild, F.lit("*")).otherwise(child))
    for k in range(LEVELS):
        tree = tree.withColumn("child", F.get("segments", F.lit(k)))
        node = ["host", "template"]
        rare = _rare(tree.where("child is not null").groupBy(*node, "child").agg(F.sum("n").alias("m")), node)
        longer = F.concat("template", F.coalesce(step(F.col("wild"), F.col("child")), F.lit("")))
        tree = stash(tree.join(rare, [*node, "child"], "left").withColumn("template", longer).drop("wild", "child"), "tree")
    more = F.size("segments")
    deep = tree.where(more > LEVELS).select("host", "shape", "n", "template", more.alias("size"), F.posexplode("segments").alias("place", "child")).where(F.col("place") >= LEVELS)
    node = ["host", "template", "size", "place"]
    rare = _rare(deep.groupBy(*node, "child").agg(F.sum("n").alias("m")), node)
    deep = deep.join(rare, [*node, "child"], "left").withColumn("text", step(F.coalesce("wild", F.lit(False)), F.col("child")))
    deep = deep.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("tail"))
    deep = deep.select("host", "shape", F.array_join("tail.text", "").alias("tail"))
    return tree.join(deep, ["host", "shape"], "left").withColumn("template", F.concat("template", F.coalesce("tail", F.lit("")))).drop("tail", "segments")


def template_tree(shapes: DataFrame) -> DataFrame:
    """``shapes(host, shape, n, block, allow)`` with ``template`` and ``purity``."""
    tree = stash(templates(shapes), "templates")
    rest = F.regexp_replace("template", "^/[^/]*", "")
    counts = tree.groupBy("host", "template").agg(F.sum("block").alias("b"), F.sum(F.col("block") + F.col("allow")).alias("m"))
    counts = stash(counts.withColumn("rest", rest), "branches")
    pool = counts.groupBy("host", "rest").agg(F.sum("b").alias("pb"), F.sum("m").alias("pm"))
    # ratios of branches without labels are null, and so is what follows from them
    rate, pooled = F.col("b") / F.nullif("m", F.lit(0)), F.col("pb") / F.nullif("pm", F.lit(0))
    error = F.sqrt(pooled * (1 - pooled) * (1.0 / F.nullif("m", F.lit(0)) + 1.0 / F.nullif("pm", F.lit(0))))
    counts = counts.join(pool, ["host", "rest"]).withColumn("merged", F.coalesce(F.abs(rate - pooled) <= Z * error, F.lit(True)))
    joint = counts.where("merged").groupBy("host", "rest").agg(F.sum("b").alias("jb"), F.sum("m").alias("jm"))
    hosts = counts.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("m").alias("hm"))
    prior = shapes.agg((F.sum("block") / F.greatest(F.sum(F.col("block") + F.col("allow")), F.lit(1))).alias("prior"))
    counts = counts.join(joint, ["host", "rest"], "left").join(hosts, "host")
    # the prior is one row, read as a scalar
    purity = F.coalesce(prior.scalar(), F.lit(0.0))
    for b, m in (("hb", "hm"), ("jb", "jm")):
        purity = (F.coalesce(b, F.lit(0)) + SMOOTH * purity) / (F.coalesce(m, F.lit(0)) + SMOOTH)
    purity = F.when(F.col("merged"), purity).otherwise((F.col("b") + SMOOTH * purity) / (F.col("m") + SMOOTH))
    judged = counts.select("host", "template", F.when(F.col("merged"), F.concat(F.lit("/*"), "rest")).otherwise(F.col("template")).alias("joined"), purity.alias("purity"))
    return tree.join(judged, ["host", "template"]).select("host", "shape", F.col("joined").alias("template"), "purity")


def judge(pages: DataFrame, rules=RULES, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) of every page."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", F.regexp_replace("path", "[0-9]+", "{n}").alias("shape"), name.alias("rule"), verdict.alias("ruled"))
    shapes = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("block"), F.count_if(F.col("ruled") == "allow").alias("allow")
    )
    tree = stash(template_tree(stash(shapes, "shapes")), "judged")
    learned = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(tree, ["host", "shape"]).select(
        key, "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", F.round("purity", 6).alias("purity")
    )


def op8_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    name, verdict = "null", "null"
    for v, h, p in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
        name, verdict = f"case {fits} then '{h}{p}' else {name} end", f"case {fits} then '{v}' else {verdict} end"
    steps = [
        "rest_ as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages)",
        "raw_ as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') h from rest_)",
        f"cut_ as (select page_id, translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}') host,"
        " regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') path from raw_)",
        f"rows_ as (select *, regexp_replace(path, '[0-9]+', '{{n}}', 'g') shape, {name} as rule, {verdict} ruled from cut_)",
        "shapes as (select host, shape, count(*) n, count(*) filter (ruled = 'block') block, count(*) filter (ruled = 'allow') allow from rows_ group by all)",
        "t0 as (select *, string_split(shape, '/')[2:] segments, '' template from shapes)",
    ]

    def rare(name: str, source: str, node: str) -> None:
        steps.append(f"m_{name} as (select {node}, child, sum(n) m from {source} where child is not null group by all)")
        steps.append(f"n_{name} as (select *, m * {SHARE} < sum(m) over (partition by {node}) minor from m_{name})")
        steps.append(f"r_{name} as (select {node}, child, true as wild from (select *, count(*) filter (minor) over (partition by {node}) k from n_{name}) where minor and k >= {CHILDREN})")

    for k in range(LEVELS):
        steps.append(f"c{k} as (select *, segments[{k + 1}] child from t{k})")
        rare(str(k), f"c{k}", "host, template")
        steps.append(
            f"t{k + 1} as (select * exclude (child, wild) replace (template || coalesce('/' || case when wild then '*' else child end, '') as template)"
            f" from c{k} left join r_{k} using (host, template, child))"
        )
    steps.append(f"d as (select host, shape, n, template, len(segments) size, unnest(range({LEVELS}, len(segments))) place, unnest(segments[{LEVELS + 1}:]) child from t{LEVELS} where len(segments) > {LEVELS})")
    rare("d", "d", "host, template, size, place")
    steps += [
        "e as (select host, shape, string_agg('/' || case when wild then '*' else child end, '' order by place) tail from d left join r_d using (host, template, size, place, child) group by all)",
        f"tree as (select t.* exclude (segments) replace (template || coalesce(tail, '') as template) from t{LEVELS} t left join e using (host, shape))",
        "counts as (select host, template, regexp_replace(template, '^/[^/]*', '') rest, sum(block) b, sum(block + allow) m from tree group by all)",
        "pool as (select host, rest, sum(b) pb, sum(m) pm from counts group by all)",
        f"marked as (select counts.*, m = 0 or abs(b / m - pb / pm) <= {Z} * sqrt((pb / pm) * (1 - pb / pm) * (1.0::double / m + 1.0::double / pm)) merged from counts join pool using (host, rest))",
        "joint as (select host, rest, sum(b) jb, sum(m) jm from marked where merged group by all)",
        "hosts as (select host, sum(b) hb, sum(m) hm from counts group by all)",
        "prior_ as (select coalesce(sum(block) / greatest(sum(block + allow), 1), 0.0) prior from shapes)",
    ]
    purity = "(select prior from prior_)"
    for b, m in (("hb", "hm"), ("coalesce(jb, 0)", "coalesce(jm, 0)")):
        purity = f"({b} + {SMOOTH}::double * {purity}) / ({m} + {SMOOTH}::double)"
    steps += [
        f"smooth as (select marked.*, {purity} p from marked left join joint using (host, rest) join hosts using (host))",
        f"judged as (select host, template, case when merged then '/*' || rest else template end as joined, case when merged then p else (b + {SMOOTH}::double * p) / (m + {SMOOTH}::double) end purity from smooth)",
    ]
    return f"""with {", ".join(steps)}
        select page_id, r.host, path, rule, coalesce(ruled, case when purity >= {REJECT} then 'block' else 'allow' end) verdict, joined as template, round(purity, 6) purity
        from rows_ r join tree t on r.host = t.host and r.shape = t.shape join judged j on t.host = j.host and t.template = j.template"""


ORACLE_SQL = _sql()

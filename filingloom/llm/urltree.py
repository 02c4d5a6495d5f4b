"""URL filter: rules, and a tree of path templates for the urls that no rule decides.

Rules are (host, path, verdict); one fits a host and its subdomains if the path
starts with the rule's, and the longest decides.

The tree, per host:

* a path's segments that hold a digit, or none at all, are variables at once
  (``*``); so are segments that fewer than one in ``RARE`` urls of their
  siblings take; below ``DEPTH`` segments the rest of a path is one variable
  (``**``);
* a branch that can't be told from its siblings is merged with them into ``*``.
  It is told apart if a two-sample test on counts (its own against its
  siblings', at ``Z`` standard errors with the correction for continuity)
  rejects that they are alike: in what lies below them (end, variable, literal),
  in the share of blocked urls among labelled ones, or in that share for the same
  paths over all hosts, so that a host without labels is cut like the others;
* a template is rejected if the share of blocked urls among its labelled ones is
  over one half, smoothed towards the share of the same template over all hosts,
  that one towards the share of the host, and that one towards the share of all
  urls.  The labels are the verdicts of the rules; a template without any
  inherits what equal templates of other hosts and its own host say.

Urls are first reduced to one row per (host, shape) with counts, so the tree is
built from partial sums.  Whatever joins rows to a node, host or template cuts
keys with very many rows into parts (``join_by_size``); nodes go by digests, so
that what is broadcast is bounded.  Steps are written to the shared folder.

Defined cases: a null url, or one without ``://``, has empty host and path, fits
no rule and is judged by the template ``/`` of the empty host; without any
label everything is allowed, and a share of exactly one half is allowed; a url's
length and number of segments are unbounded; repeated rows get equal verdicts;
extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import Scratch, join_by_size

#: The rules of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
RARE = 20
PRIOR = 2
"""Weight of the smoothing, in labelled urls."""
DEPTH = 32
Z = 2.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest fitting rule as struct(length, rule, verdict), or null.

    A host's suffixes are looked up in a map of the rules, so the work of a row
    follows its labels, not the number of rules.
    """
    by_host: dict[str, list] = {}
    for of, start, verdict in rules:
        by_host.setdefault(of, []).append(F.struct(F.lit(len(of) + len(start)).alias("length"), F.lit(start).alias("path"), F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict")))
    known = F.create_map(*[x for of, own in by_host.items() for x in (F.lit(of), F.array(*own))])
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def shape_of(path: Column) -> Column:
    """Segments with variables as ``*``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    marked = F.transform(F.slice(segments, 1, DEPTH), lambda s: F.when(s.rlike("[0-9]") | (s == "*"), "*").otherwise(s))
    return F.when(F.size(segments) > DEPTH, F.concat(marked, F.array(F.lit("**")))).otherwise(marked)


def digest(*parts: Column | str) -> Column:
    """Parts hold no line end where they could be mistaken: hosts and segments are joined by "/", which neither holds."""
    return F.md5(F.concat_ws("/", *parts))


def alike(part: str, of: str, parts: str, all_: str) -> Column:
    """Whether ``part`` of ``of`` can't be told from the rest of ``parts`` of ``all_``: a two-sample test of shares."""
    x, n, t, m = (F.col(c).cast("double") for c in (part, of, parts, all_))
    apart = F.greatest(F.abs(x * (m - n) - (t - x) * n) - m / 2, F.lit(0.0))
    return apart * apart * m <= Z * Z * t * (m - t) * n * (m - n)


COUNTS = ("urls", "blocked", "labelled", "below0", "below1", "below2")


def tree_of(shapes: DataFrame) -> DataFrame:
    """Nodes: ``key, parent, path_key, path_parent, segment``, the counts of urls through them and ``shapes``, the number of rows through them."""
    depth = F.size("shape")
    nodes = nodes_of(shapes)
    kind = F.when(F.col("depth") == depth, 0).when(F.get("shape", F.col("depth")).isin("*", "**"), 1).otherwise(2)
    below = [F.sum(F.when(kind == k, F.col("urls")).otherwise(0)).alias(f"below{k}") for k in range(3)]
    up = lambda *start: digest(*start, F.slice("shape", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))))
    own = nodes.withColumns({"parent": up("host"), "path_parent": up(), "path_key": digest(F.slice("shape", F.lit(1), F.col("depth"))), "segment": F.get("shape", F.col("depth") - 1)})
    return own.where("depth > 0").groupBy("key", "parent", "path_key", "path_parent", "segment").agg(F.sum("urls").alias("urls"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), *below, F.count("*").alias("shapes"))


def nodes_of(shapes: DataFrame) -> DataFrame:
    """A row for each (host, shape) and depth, with the digest of the node there."""
    rows = shapes.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("shape"))))
    return rows.withColumn("key", digest("host", F.slice("shape", F.lit(1), F.col("depth"))))


def pooled(nodes: DataFrame, parent: str) -> DataFrame:
    """The sums over the children of each parent, and how many there are."""
    return nodes.groupBy(parent).agg(*[F.sum(c).alias(f"all_{c}") for c in COUNTS], F.count("*").alias("children"))


def steps_of(tree: DataFrame, size: int) -> DataFrame:
    """``key, step, shapes``: what each node's segment becomes in templates."""
    # over all hosts: are the labels below a path those of its siblings'?
    paths = tree.groupBy("path_key", "path_parent").agg(*[F.sum(c).alias(c) for c in COUNTS], F.count("*").alias("nodes"))
    paths = join_by_size(paths, pooled(paths, "path_parent"), "path_parent", size="children", total=size)
    paths = paths.select("path_key", alike("blocked", "labelled", "all_blocked", "all_labelled").alias("everywhere"), "nodes")
    nodes = join_by_size(tree, pooled(tree, "parent"), "parent", size="children", total=size)
    nodes = join_by_size(nodes, paths, "path_key", size="nodes", total=size)
    same = alike("blocked", "labelled", "all_blocked", "all_labelled") & F.col("everywhere")
    for k in range(3):
        same = same & alike(f"below{k}", "urls", f"all_below{k}", "all_urls")
    variable = F.col("segment").isin("*", "**") | (F.col("urls") * RARE < F.col("all_urls")) | (same & (F.col("urls") < F.col("all_urls")))
    return nodes.select("key", F.when(F.col("segment") == "**", "**").when(variable, "*").otherwise(F.col("segment")).alias("step"), "shapes")


def templates(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """``page, urls, template, share`` from (page, host, shape, urls, blocked, labelled) rows; page is the digest of host and shape."""
    tree = scratch.write(tree_of(shapes), "tree")
    total = scratch.rows(tree)
    steps = scratch.write(steps_of(tree, total), "steps")
    placed = nodes_of(shapes).where("depth > 0").select("page", "depth", "key")
    # every (host, shape) has a row for each of its nodes
    whole = join_by_size(placed, steps, "key", size="shapes", total=scratch.rows(shapes)).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("depth", "step"))).alias("steps"))
    named = shapes.join(whole, "page", "left").withColumn("template", F.coalesce(F.concat(F.lit("/"), F.array_join(F.col("steps")["step"], "/")), F.lit("/")))
    named = named.select("page", "urls", "blocked", "labelled", "template", F.md5("host").alias("host"), F.md5("template").alias("alias"), digest("host", "template").alias("own"))
    named = scratch.write(named, "named")
    sums = named.groupBy("own", "host", "alias").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"), F.count("*").alias("pages"))
    over = lambda key, b, n: sums.groupBy(key).agg(F.sum("b").alias(b), F.sum("n").alias(n), F.count("*").alias("rows"))
    base = sums.agg(F.coalesce(F.sum("b") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("base")).first()["base"]
    judged = join_by_size(sums, over("host", "hb", "hn"), "host", size="rows", total=scratch.rows(named))
    judged = join_by_size(judged, over("alias", "tb", "tn"), "alias", size="rows", total=scratch.rows(named))
    by_host = (F.col("hb") + PRIOR * F.lit(base)) / (F.col("hn") + PRIOR)
    by_alias = (F.col("tb") + PRIOR * by_host) / (F.col("tn") + PRIOR)
    share = (F.col("b") + PRIOR * by_alias) / (F.col("n") + PRIOR)
    judged = scratch.write(judged.select("own", share.alias("share"), "pages"), "judged")
    return join_by_size(named.select("page", "urls", "template", "own"), judged, "own", size="pages", total=scratch.rows(named)).drop("own")


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, share`` of every row."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    rows = rows.select("page_id", "host", "path", "shape", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule"))
    blocked = F.count_if(F.coalesce(F.col("by_rule") == "block", F.lit(False)))
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("urls"), blocked.alias("blocked"), F.count("by_rule").alias("labelled"))
    shapes = scratch.write(shapes.withColumn("page", digest("host", "shape")), "shapes")
    found = scratch.write(templates(shapes, scratch), "found")
    total = shapes.agg(F.coalesce(F.sum("urls"), F.lit(0)).alias("urls")).first()["urls"]
    known = rows.withColumn("page", digest("host", "shape")).drop("shape")
    judged = join_by_size(known, found, "page", size="urls", total=total)
    by_tree = F.when(F.col("share") > 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "template", F.round("share", 6).alias("share"))

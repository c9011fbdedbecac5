"""URL filtering by explicit rules and a path-template tree (DataFrame functions only).

Rules decide the URLs they fit. For the others the method learns from labelled URLs: per host,
paths form a tree whose variable segments become wildcards, branching by branching: segments that all
paths of a branch share are passed at once, so rounds follow the branchings along a path, not its
depth. A template is a generalised path. Under a branch with at most ``MOST_CHILDREN`` different paths nothing can turn out
variable by number, so those paths are its children as a whole, however long. Sibling branches whose labelled shares don't differ statistically are merged.
A branch's share of bad labels is smoothed towards what its parent says, and the root's towards a
prior. The parent counts as far as its pages are labelled: where half of them are, a branch without
labels lies half-way between the parent's share and the prior. A template is rejected if its
smoothed share passes a threshold.

Everything is counted over distinct (host, path) rows. A host with a third of all pages is counted
by branch first, and its rows are joined by broadcast (``join_counted``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut_lineage, join_counted

#: A branch with more children than this, and more than this share of its pages, is variable.
MOST_CHILDREN, CHILD_SHARE = 16, 0.3
#: Pseudo-labels of the smoothing, the root's share of bad labels, and the rejected share.
PRIOR_WEIGHT, PRIOR_BAD, REJECT_AT = 1.0, 0.25, 0.5
#: Siblings merge if the two-proportion z statistic stays below this.
SAME_BELOW = 1.96

#: Segments that are variable by their form: numbers, dates, hexadecimal ids, and long mixes of both.
VARIABLE = r"^(?:[0-9]+(?:[-_.][0-9]+)*|[0-9a-f]{8,}(?:-[0-9a-f]{4,})*|(?=.*[0-9])[0-9A-Za-z_-]{16,})(?:\.[a-z]{2,5})?$"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z in lower case; '' if there is none."""
    host = F.regexp_extract(url, r"(?s)^(?>.*?://)([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; '' if there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (verdict, ``host/path``) that fits; null if none does.

    A rule fits its host and every subdomain, and paths that start with its own. A rule's path
    is what follows its host, so ``net/`` has the path ``/``.
    """
    fits = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        on_host = (host == domain) | host.endswith(f".{domain}")
        fits = F.when(on_host & path.startswith(f"/{rest}"), F.lit(rule)).otherwise(fits)
    return fits


def templates(labelled: DataFrame) -> DataFrame:
    """(host, path, names, rows, good, bad) for every distinct host and path; ``names`` are the template's branches.

    ``labelled`` holds (host, path, good, bad) with one row for each page, good and bad being 0 or 1.
    What all paths of a branch start with is what the first and the last of them in order start with.
    """
    tree = labelled.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    open_rows = cut_lineage(tree.withColumn("left", segments).withColumn("names", F.array().cast("array<string>")))
    done = []
    while True:
        done.append(open_rows.where(F.size("left") == 0).drop("left"))
        open_rows = open_rows.where(F.size("left") > 0).withColumn("here", F.get("left", F.lit(0)))
        total = open_rows.count()
        if not total:
            return reduce(DataFrame.unionByName, done)
        children = open_rows.groupBy("host", "names", "here").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n"), F.min("left").alias("least"), F.max("left").alias("most"))
        nodes = children.groupBy("host", "names").agg(F.count(F.lit(1)).alias("kinds"), F.sum("rows").alias("below"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        differs = F.array_position(F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b)), F.lit(False))
        shared = F.when(differs == 0, F.size("least")).otherwise(differs - 1).cast("int")
        variable = (F.col("kinds") > MOST_CHILDREN) & (F.col("kinds") > CHILD_SHARE * F.col("below"))
        nodes = cut_lineage(nodes.select("host", "names", variable.alias("variable"), (F.col("n") <= MOST_CHILDREN).alias("few"), shared.alias("shared"), "n"))
        passed = F.greatest(F.col("shared"), F.lit(1))
        name = F.when(F.col("few"), F.array(F.array_join("left", "/"))).when(F.col("variable"), F.array(F.lit("*"))).otherwise(F.slice("left", F.lit(1), passed))
        left = F.when(F.col("few"), F.array().cast("array<string>")).otherwise(F.slice("left", passed + 1, F.size("left")))
        named = join_counted(open_rows, nodes, ["host", "names"], total)
        open_rows = cut_lineage(named.select("host", "path", "rows", "good", "bad", left.alias("left"), F.concat("names", name).alias("names")))


def _smoothed(bad: Column, labels: Column, towards: Column) -> Column:
    return (bad + PRIOR_WEIGHT * towards) / (labels + PRIOR_WEIGHT)


def _backed(rows: Column, labels: Column, impurity: Column) -> Column:
    """What a branch says to its children, as far as its pages are labelled."""
    return F.lit(PRIOR_BAD) + labels / rows * (impurity - PRIOR_BAD)


def _chain_impurities(head: Column, chain: Column) -> Column:
    """Impurities of a chain of branches, each the only child of the one before, from that of its first: an array."""
    start = F.struct(F.array(head).alias("found"), F.get(chain, F.lit(0))["rows"].alias("rows"), F.get(chain, F.lit(0))["labels"].alias("labels"), head.alias("impurity"))

    def step(done: Column, node: Column) -> Column:
        impurity = _smoothed(node["bad"], node["labels"], _backed(done["rows"], done["labels"], done["impurity"]))
        return F.struct(F.concat(done["found"], F.array(impurity)).alias("found"), node["rows"].alias("rows"), node["labels"].alias("labels"), impurity.alias("impurity"))

    return F.aggregate(F.slice(chain, F.lit(2), F.size(chain)), start, step, lambda done: done["found"])


def _chains(tree: DataFrame) -> tuple[DataFrame, int]:
    """The branches of the tree as (host, parent, tail, level, chain, all_bad, all_labels), and the deepest level.

    A chain is a branch with sisters (or the root) and what follows while there is one child only: an
    array of (depth, names, n, rows, bad, labels). ``parent`` names the branch above, ``tail`` is the last
    of the chain, ``level`` the number of chains above it; all_bad and all_labels count the first
    branch and its sisters.
    """
    own = tree.groupBy("host", "names").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    branch = cut_lineage(own.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("names")))).withColumn("branch", F.slice("names", 1, F.col("depth"))))
    ends_here = F.when(F.size("names") == F.col("depth"), F.col("n")).otherwise(0)
    nodes = branch.groupBy("host", "depth", F.col("branch").alias("names")).agg(
        F.sum(ends_here).alias("n"), F.sum("rows").alias("rows"), F.sum("bad").cast("double").alias("bad"), F.sum(F.col("good") + F.col("bad")).cast("double").alias("labels"), F.count(F.lit(1)).alias("templates")
    )
    nodes = cut_lineage(nodes.withColumn("parent", F.slice("names", 1, F.greatest(F.col("depth") - 1, F.lit(0)))))
    family = cut_lineage(nodes.where("depth > 0").groupBy("host", "parent").agg(F.sum("bad").alias("all_bad"), F.sum("labels").alias("all_labels"), F.count(F.lit(1)).alias("kin")))
    below = join_counted(nodes.where("depth > 0").withColumnRenamed("n", "ending"), family.withColumn("n", F.col("kin")), ["host", "parent"], nodes.count()).withColumnRenamed("ending", "n")
    root = nodes.where("depth = 0").select("*", F.col("bad").alias("all_bad"), F.col("labels").alias("all_labels"), F.lit(0).cast("bigint").alias("kin"))
    nodes = cut_lineage(below.unionByName(root))
    # Where chains begin on the way to each template.
    begins = nodes.select("host", F.col("names").alias("branch"), (F.col("kin") != 1).alias("begins"), F.col("templates").alias("n"))
    on_way = join_counted(branch.select("host", "names", "depth", "branch"), begins, ["host", "branch"], branch.count())
    way = Window.partitionBy("host", "names").orderBy("depth")
    placed = on_way.select("host", "branch", F.max(F.when(F.col("begins"), F.col("depth"))).over(way).alias("head"), (F.sum(F.col("begins").cast("int")).over(way) - 1).alias("level"))
    placed = placed.groupBy("host", F.col("branch").alias("names")).agg(F.first("head").alias("head"), F.first("level").alias("level"))
    node = F.struct("depth", "names", "n", "rows", "bad", "labels")
    first = F.col("depth") == F.col("head")
    told = nodes.join(placed, ["host", "names"]).groupBy("host", F.slice("names", 1, F.col("head")).alias("first"), "level").agg(
        F.sort_array(F.collect_list(node)).alias("chain"), F.max(F.when(first, F.col("all_bad"))).alias("all_bad"), F.max(F.when(first, F.col("all_labels"))).alias("all_labels"), F.max(F.when(first, F.col("kin"))).alias("kin")
    )  # a chain is no longer than a path
    parent = F.slice("first", 1, F.greatest(F.size("first") - 1, F.lit(0)))
    chains = cut_lineage(told.select("host", parent.alias("parent"), F.element_at("chain", -1)["names"].alias("tail"), "level", "chain", "all_bad", "all_labels", F.col("kin").alias("n")))
    return chains, chains.agg(F.max("level")).first()[0] or 0


def judged_templates(tree: DataFrame) -> DataFrame:
    """(host, names, impurity, n) of every branch: its smoothed share of bad labels, from the root down; n rows of ``tree`` have it as template.

    Chains of only children are judged at once, so there are as many rounds as branchings along a path.
    """
    chains, deepest = _chains(tree)
    total = chains.count()
    found, tails = [], None
    for level in range(deepest + 1):
        here, first = chains.where(F.col("level") == level), F.get("chain", F.lit(0))
        if tails is None:
            head = _smoothed(first["bad"], first["labels"], F.lit(PRIOR_BAD))
        else:
            counted = cut_lineage(here.groupBy("host", "parent").agg(F.first("n").alias("n")).join(tails, ["host", "parent"]))
            here = join_counted(here.withColumnRenamed("n", "kin"), counted, ["host", "parent"], total)
            n, m, bad = first["labels"], F.col("all_labels"), first["bad"]
            rest = m - n
            share, rest_share, pooled = bad / n, (F.col("all_bad") - bad) / rest, F.col("all_bad") / m
            spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / rest))
            # Without labels on both sides there is nothing to compare, and the branch stands alone.
            alike = F.when((n > 0) & (rest > 0), F.when(spread == 0, F.lit(True)).otherwise(F.abs(share - rest_share) / spread < SAME_BELOW)).otherwise(False)
            head = _smoothed(F.when(alike, F.col("all_bad")).otherwise(bad), F.when(alike, m).otherwise(n), F.col("backed"))
        judged = cut_lineage(here.select("host", "tail", "chain", _chain_impurities(head, F.col("chain")).alias("impurities")))
        found.append(judged)
        last = F.element_at("chain", -1)
        tails = judged.select("host", F.col("tail").alias("parent"), _backed(last["rows"], last["labels"], F.element_at("impurities", -1)).alias("backed"))
    every = reduce(DataFrame.unionByName, found).select("host", F.explode(F.arrays_zip("chain", "impurities")).alias("c"))
    return every.select("host", "c.chain.names", F.col("c.impurities").alias("impurity"), "c.chain.n")


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of ``pages`` (page_id, url).

    The labels that the tree learns from are the verdicts of the rules.

    Defined cases: a null url, or one without ``://``, has an empty host and path and is judged like
    any other; repeated rows are each judged; a null page_id is kept; an empty table gives an empty
    one; other columns are not read.
    """
    verdict_of = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdict_of = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdict_of)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict_of)
    labelled = rows.select("host", "path", F.coalesce((F.col("ruled") == "allow").cast("int"), F.lit(0)).alias("good"), F.coalesce((F.col("ruled") == "block").cast("int"), F.lit(0)).alias("bad"))
    tree = cut_lineage(templates(labelled))
    judged = cut_lineage(judged_templates(tree).where("n > 0"))
    known = join_counted(tree.select("host", "path", "names", "rows"), judged, ["host", "names"], tree.count())
    known = known.select("host", "path", F.array_join(F.transform("names", lambda s: F.concat(F.lit("/"), s)), "").alias("template"), "impurity", F.col("rows").alias("n"))
    out = join_counted(rows, cut_lineage(known), ["host", "path"], tree.agg(F.sum("rows")).first()[0] or 0)
    method = F.when(F.col("impurity") > REJECT_AT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", (1 - F.col("impurity")).alias("purity"))

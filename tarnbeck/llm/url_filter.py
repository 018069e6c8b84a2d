"""URL filters by a path-template tree.

Per host, paths form a tree of segments, each with its pages, the labelled ones among them and the bad ones.
A segment that looks like a number, a long hexadecimal number or a name with digits takes a typed
wildcard. Level by level, the branches below one parent are then told apart by what their labels say:

* a branch stands apart if its bad share could not well be that of all labelled pages below the parent,
  by Chernoff's bound on the binomial, corrected for the number of branches. Branches that stand apart
  are merged with those of similar share, by the same bound for two samples;
* all other labelled branches are similar, and merged (`+`);
* branches without labelled pages have nothing to tell them apart, and are merged (`*`);
* if most pages bring a segment of their own (the lower bound of Good and Turing's share of unseen ones is
  above a half), the segment is variable: whatever does not stand apart becomes one wildcard (`*`).

A merged branch goes on as one node, so whole subtrees merge. A branch is kept as it is, though, if anything
below it stands apart from its siblings, for then one share does not describe it. A template is rejected if
it has labelled pages and its purity, the bad share smoothed towards that of its parent, that towards its
host's and that towards the mean, reaches a threshold. No number of branches, pages or levels is a limit.

The tree is built from counts: pages are aggregated to (host, path of generalised segments) before anything
is shuffled; parents with many branches are split (splits.py); what one task gathers of a parent is the
distinct pairs of labelled and bad counts among branches that stand apart, not the branches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.splits import join_split
from tarnbeck.llm.store import Store
from tarnbeck.llm.text import bounded_batches


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and for the paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


@dataclass(frozen=True)
class Purity:
    """strength: labelled pages that each prior counts as. reject: least smoothed share of bad pages. chance: probability of telling apart, below one parent, what does not differ."""

    strength: float = 8.0
    reject: float = 0.7
    chance: float = 0.05

    def bound(self, branches: int) -> float:
        return math.log(2 * branches / self.chance)


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z in lower case; empty without :// and for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def match_rules(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """`value` of the longest rule that fits, else null. Equal lengths: the first by text."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def generalise(segment: Column) -> Column:
    """A typed wildcard for what looks like a number, a long hexadecimal number or a name with digits; its extension stays."""
    stem, tail = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{x}"))
        .when(stem.rlike(r"[0-9]"), F.lit("{w}"))
        .otherwise(stem)
    )
    return F.concat(kind, tail)


def excess(bad: Column, labelled: Column, share: Column) -> Column:
    """Chernoff's exponent: labelled times the relative entropy of the bad share to `share`; the binomial tail is below its negative exponential."""
    good = labelled - bad
    return F.when(bad > 0, bad * F.log(bad / (labelled * share))).otherwise(0.0) + F.when(good > 0, good * F.log(good / (labelled * (1 - share)))).otherwise(0.0)


def apart(bad: float, n: float, bad2: float, n2: float) -> float:
    """The same exponent for two samples and their common share."""
    p, out = (bad + bad2) / (n + n2), 0.0
    for b, m in ((bad, n), (bad2, n2)):
        for x, q in ((b, p), (m - b, 1 - p)):
            out += x * math.log(x / (m * q)) if x > 0 else 0.0
    return out


def _merge(rows: pd.DataFrame, purity: Purity) -> pd.DataFrame:
    """Groups branches in the order of their bad shares, while neighbours are similar. A row stands for `alike` branches of equal counts, the first of them by name `branch`."""
    rows = rows.assign(share=rows.bad / rows.labelled).sort_values(["share", "labelled"]).reset_index(drop=True)
    bound, groups = purity.bound(int(rows.kinds.iloc[0])), []
    for k, (bad, n, alike) in enumerate(zip(rows.bad, rows.labelled, rows.alike, strict=True)):
        if groups and apart(groups[-1][1], groups[-1][2], bad, n) <= bound:
            groups[-1] = (groups[-1][0] + [k], groups[-1][1] + alike * bad, groups[-1][2] + alike * n)
        else:
            groups.append(([k], alike * bad, alike * n))
    first, together = [""] * len(rows), [0] * len(rows)
    for members, _, _ in groups:
        for k in members:
            first[k], together[k] = rows.branch[members].min(), int(rows.alike[members].sum())
    return rows.assign(first=first, together=together)[["host", "template", "bad", "labelled", "first", "together"]]


def mixed_branches(paths: DataFrame, purity: Purity, store: Store) -> DataFrame:
    """below: the hash of every (host, segments so far) below which a branch stands apart from its siblings."""

    def so_far(depth) -> Column:
        return F.xxhash64("host", F.slice("parts", 1, depth))

    nodes = paths.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("parts"))))
    nodes = nodes.groupBy(so_far(F.col("depth")).alias("node"), so_far(F.col("depth") - 1).alias("key")).agg(*(F.sum(c).alias(c) for c in ("labelled", "bad"))).filter("labelled > 0")
    nodes = store.put(nodes, "nodes")
    parents = nodes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")).filter("kinds > 1")
    share = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
    stands = excess(F.col("bad"), F.col("labelled"), share) > F.log(2 * F.col("kinds") / purity.chance)
    parents = store.put(parents, "parents")
    total = parents.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    found = join_split(nodes, parents, "key", "kinds", total).filter(stands).select(F.col("key").alias("below")).distinct()
    # with their ancestors
    found = store.put(found, "apart")
    steps = paths.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("parts")))).select("host", "parts", "depth", so_far(F.col("depth")).alias("below"))
    held = steps.join(found, "below").withColumn("up", F.explode(F.sequence(F.lit(1), F.col("depth")))).select(so_far(F.col("up")).alias("below")).distinct()
    return store.put(held, "mixed")


def template_tree(paths: DataFrame, purity: Purity, store: Store) -> DataFrame:
    """host, parts, n, labelled, bad and the template of each path, from the first five."""
    mixed = mixed_branches(paths, purity, store)
    tree = store.put(paths.withColumn("rest", F.col("parts")).withColumn("template", F.lit("")), "paths")
    depth = 0
    while depth < (tree.agg(F.max(F.size("rest"))).first()[0] or 0):
        level = tree.withColumn("branch", F.get("rest", F.lit(depth)))
        going = level.filter("branch is not null")
        branches = going.groupBy("host", "template", "branch").agg(
            F.count("*").alias("paths"), *(F.sum(c).alias(c) for c in ("n", "labelled", "bad")), F.min(F.xxhash64("host", F.slice("parts", 1, depth + 1))).alias("below")
        )
        branches = store.put(branches.withColumn("key", F.struct("host", "template")), "branches")
        known = F.col("labelled") > 0
        parents = branches.groupBy("key").agg(
            F.count("*").alias("kinds"), F.sum("paths").alias("all_paths"), F.sum("n").alias("all"), F.sum((F.col("n") == 1).cast("long")).alias("once"),
            F.sum(known.cast("long")).alias("known"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"),
        )
        parents = store.put(parents, "parents")
        rows = parents.agg(F.sum("kinds")).first()[0] or 0
        held = join_split(branches, parents, "key", "kinds", rows).join(mixed.withColumn("mixed", F.lit(True)), "below", "left")
        stands = excess(F.col("bad"), F.col("labelled"), (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)) > F.log(2 * F.col("known") / purity.chance)
        z2, unseen = 1.96**2, F.col("once") / F.col("all")
        variable = (unseen + z2 / (2 * F.col("all")) - 1.96 * F.sqrt((unseen * (1 - unseen) + z2 / (4 * F.col("all"))) / F.col("all"))) / (1 + z2 / F.col("all")) > 0.5
        kind = F.when(F.col("mixed"), "mixed").when(known & stands, "apart").when(variable, "*").when(known, "+").otherwise("*")
        held = store.put(held.select("key", "host", "template", "branch", "bad", "labelled", "all_paths", "known", "kinds", kind.alias("kind")), "kinds")

        alone = held.groupBy("key").agg(F.first("kinds").alias("kinds"), *(F.sum((F.col("kind") == k).cast("long")).alias(name) for k, name in (("*", "any"), ("+", "similar"))))
        pairs = held.filter("kind = 'apart'").groupBy("host", "template", "bad", "labelled", F.col("known").alias("kinds")).agg(F.count("*").alias("alike"), F.min("branch").alias("branch"))
        merged = bounded_batches(pairs).groupBy("host", "template").applyInPandas(lambda r: _merge(r, purity), "host string, template string, bad long, labelled long, first string, together long")
        merged = store.put(merged.select(F.struct("host", "template").alias("key"), "bad", "labelled", "first", "together"), "merged")
        named = join_split(held.drop("kinds"), alone, "key", "kinds", rows).join(merged, ["key", "bad", "labelled"], "left")
        name = (
            F.when((F.col("kind") == "apart") & (F.col("together") > 1), F.concat(F.lit("="), "first"))
            .when((F.col("kind") == "*") & (F.col("any") > 1), F.lit("*"))
            .when((F.col("kind") == "+") & (F.col("similar") > 1), F.lit("+"))
            .otherwise(F.col("branch"))
        )
        named = named.select("host", "template", "branch", name.alias("name"), (F.col("all_paths") == 1).alias("only"))
        ended = F.concat("template", F.lit("/"), F.array_join(F.slice("rest", depth + 1, F.size("rest")), "/"))  # the only path below a parent has no more to decide
        last = tree
        tree = level.join(named, ["host", "template", "branch"], "left").select(
            "host", "parts", "n", "labelled", "bad",
            F.when(F.col("only"), F.slice("rest", 1, depth)).otherwise(F.col("rest")).alias("rest"),
            F.when(F.col("branch").isNull(), F.col("template")).when(F.col("only"), ended).otherwise(F.concat("template", F.lit("/"), "name")).alias("template"),
        )
        tree = store.put(tree, "level")
        store.free(last, branches, parents, held, merged)
        depth += 1
    return tree.drop("rest")


def judge_templates(tree: DataFrame, purity: Purity, store: Store) -> DataFrame:
    """host, template, labelled and purity, which is 0 where the template has no labelled page.

    A template's share of bad labelled pages is drawn to that of its parent, that one to its host's, and that
    to the mean of all labelled pages.
    """
    counts = tree.groupBy("host", "template").agg(*(F.sum(c).cast("double").alias(c) for c in ("labelled", "bad")))
    counts = store.put(counts.filter("labelled > 0").withColumn("parent", F.regexp_replace("template", r"(?s)/[^/]*$", "")), "counts")
    total = counts.agg(F.sum("bad"), F.sum("labelled")).first()
    mean, k = (total[0] / total[1] if total[1] else 0.0), F.lit(purity.strength)
    hosts = counts.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.count("*").alias("templates"))
    hosts = hosts.select("host", "templates", ((F.col("bad") + k * mean) / (F.col("labelled") + k)).alias("by_host"))
    parents = counts.groupBy("host", "parent").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.count("*").alias("n"))
    rows = counts.count()
    parents = join_split(parents, hosts, "host", "templates", rows)
    parents = parents.select(F.struct("host", "parent").alias("key"), "n", ((F.col("bad") + k * F.col("by_host")) / (F.col("labelled") + k)).alias("by_parent"))
    own = (F.col("bad") + k * F.col("by_parent")) / (F.col("labelled") + k)
    return join_split(counts.withColumn("key", F.struct("host", "parent")), parents, "key", "n", rows).select("host", "template", own.alias("purity"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None, purity: Purity | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, then template and purity, for each page.

    The longest rule that fits decides; elsewhere the template does, by labelled pages of its own host only.
    Labelled pages are those of `labels` (page_id, bad 0 or 1; bad if any row of it says so), or without it
    the pages that a rule decides. A null url, or one without ://, has an empty host and path, and the
    template of an empty path. Paths and urls of any length count whole. Null page_ids and repeated rows
    each have their row; other columns play no part, whatever their names; no pages give no rows.
    """
    purity = purity or Purity()
    store = Store(pages.sparkSession, "urls")
    host, path = F.col("host"), F.col("path")
    found = (
        pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("rule", match_rules(host, path, rules, lambda r: r.text))
        .withColumn("by_rule", match_rules(host, path, rules, lambda r: r.verdict))
    )
    segments = F.split(F.regexp_replace("path", "(?s)^/", ""), "/", -1)
    found = found.withColumn("parts", F.transform(segments, generalise))
    if labels is not None:
        found = found.join(labels.select("page_id", F.col("bad").cast("int").alias("bad")).filter("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
    else:
        found = found.withColumn("bad", (F.col("by_rule") == "block").cast("int"))
    found = store.put(found, "pages")

    paths = found.groupBy("host", "parts").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0)).cast("long")).alias("bad"))
    paths = store.put(paths, "distinct-paths")
    tree = store.put(template_tree(paths, purity, store), "tree")
    judged = judge_templates(tree, purity, store)
    by_path = tree.withColumn("pages", F.col("n")).join(judged, ["host", "template"], "left").select(F.struct("host", "parts").alias("key"), "pages", "template", F.coalesce("purity", F.lit(0.0)).alias("purity"))
    by_path = store.put(by_path, "by-path")
    store.free_but(found, by_path)
    out = join_split(found.withColumn("key", F.struct("host", "parts")), by_path, "key", "pages", found.count())
    verdict = F.coalesce("by_rule", F.when(F.col("purity") >= purity.reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")

"""URL filter by a path-template tree, in DataFrame operations only.

Pages are first counted by host and path. On these counts the tree is built from the top,
one level at a time, as deep as some prefix has LEAST pages. Of a node's children those with
a real share of its pages keep their names; the others, if they are many and their entropy
is near that of all different ones, are a variable segment and become one wildcard. Under
nodes of fewer than LEAST pages, which no label could reject, all is one wildcard.

Then, from the bottom, sibling branches with the same commonest template below them are
compared: those whose pages are spread over these templates like the pages of all such
siblings together (chi-square), and whose share of bad labelled pages does not differ
significantly from theirs either, are merged. A template is
rejected if its smoothed purity, bad / (labelled + 2), is 0.8 or more and labelled pages
are at least half of its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, last_table, table, tables_made

#: Pages under a node whose children are told apart, and pages of a child that has a name of its own.
LEAST = 8
#: A child with one SHARE-th of its node's pages has a name of its own: there are SHARE of them at most.
SHARE = 20
#: Least number of other children for a wildcard; the number from which they may have LEAST pages
#: or more each on average; and how much of the greatest entropy they may lack.
CHILDREN, MANY, LACK = 8, 100, 0.2
#: Bad pages needed: 5 * bad >= 4 * (labelled + 2).
PURITY = (5, 4, 2)
#: Keys are broadcast up to so many bytes of text.
BROADCAST_BYTES = 16 << 20
#: Squared standard errors of labels, and deviations of the chi-square, within which a branch is like its siblings.
SIMILAR, SPREAD = 4.0, 3.0

#: The rules of the registered query: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def raw_path(path: Column) -> Column:
    """A path's segments that are not empty, joined by '/'. One that begins with '<' gets a
    backslash, so that none looks like a wildcard."""
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.array_join(F.transform(segs, lambda s: F.when(s.startswith("<"), F.concat(F.lit("\\"), s)).otherwise(s)), "/")


def _segments(joined: str) -> Column:
    return F.filter(F.split(joined, "/"), lambda s: s != "")


def _by_key(rows: DataFrame, small: DataFrame, keys: list[str], total: int, pages: str) -> DataFrame:
    """rows with the columns of `small`, one row for each key, of which `pages` says how many
    pages it has. Keys with many pages (20,000 keys at most) are joined map-side, so that no
    task gets all rows of a large host; so are all keys if they take few bytes."""
    n, text = small.agg(F.count(F.lit(1)), F.sum(sum((F.octet_length(k) for k in keys), F.lit(0)))).first()
    if n <= BROADCAST_ROWS and (text or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), keys)
    at = max(50_000, total // 20_000)
    big = F.broadcast(small.filter(F.col(pages) > at))
    far = rows.join(big.select(*keys), keys, "left_anti").join(small.filter(F.col(pages) <= at).hint("merge"), keys)
    return rows.join(big, keys).unionByName(far)


def _log2(n: Column) -> Column:
    return F.log2(n.cast("double"))


def templates(counts: DataFrame) -> DataFrame:
    """(host, raw, n, bad, labelled, template) of (host, raw, n, bad, labelled): where each path
    lies in its host's tree, before branches are merged."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    open_, done, level = counts.withColumn("template", F.lit("")), None, 0
    key = ["host", "template"]
    while True:
        here = table(open_.withColumn("seg", F.get(_segments("raw"), F.lit(level))), "open")
        ends, deep = here.filter("seg IS NULL").drop("seg"), here.filter("seg IS NOT NULL")
        done = ends if done is None else done.unionByName(ends)
        if deep.isEmpty():
            return done
        children = deep.groupBy(*key, "seg").agg(F.sum("n").alias("m"))
        nodes = table(children.groupBy(*key).agg(F.sum("m").alias("at_node"), F.count(F.lit(1)).alias("c")), "nodes")
        placed = _by_key(children, nodes, key, total, "at_node")
        rare = (F.col("m") < LEAST) | (SHARE * F.col("m") < F.col("at_node"))
        seen = placed.groupBy(*key).agg(
            F.max("at_node").alias("at_node"),
            F.count(F.when(rare, 1)).alias("c"),
            F.sum(F.when(rare, F.col("m"))).alias("others"),
            F.sum(F.when(rare, F.col("m") * _log2(F.col("m")))).alias("s"),
            F.collect_list(F.when(~rare, F.col("seg"))).alias("named"),  # SHARE at most
        )
        entropy = _log2(F.col("others")) - F.col("s") / F.col("others")
        wide = (F.col("c") >= CHILDREN) & ((F.col("c") >= MANY) | (F.col("others") <= LEAST * F.col("c"))) & (F.round(entropy, 6) >= F.round((1 - LACK) * _log2(F.col("c")), 6))
        judged = table(seen.select(*key, "at_node", (F.col("at_node") < LEAST).alias("few"), F.coalesce(wide, F.lit(False)).alias("wide"), "named"), "judged")
        met = _by_key(deep, judged, key, total, "at_node")
        name = F.when(F.col("few") | F.col("wide") & ~F.array_contains("named", F.col("seg")), "<*>").otherwise(F.col("seg"))
        met = met.withColumn("template", F.concat("template", F.lit("/"), name))
        kept = ["host", "raw", "n", "bad", "labelled", "template"]
        done = done.unionByName(met.filter("few").select(*kept))
        open_ = met.filter("NOT few").select(*kept)
        level += 1


def merged(leaves: DataFrame, total: int) -> DataFrame:
    """(host, template, merged) of the tree's leaves (host, template, n, bad, labelled): similar
    sibling branches as one, `<~x>` if x is the first of them."""
    now = leaves.withColumn("merged", F.col("template"))
    depth = leaves.agg(F.max(F.size(_segments("template")))).first()[0] or 0
    for level in range(depth, 0, -1):
        segs = _segments("merged")
        parts = now.select("*", F.array_join(F.slice(segs, 1, level - 1), "/").alias("parent"), F.get(segs, F.lit(level - 1)).alias("branch"), F.array_join(F.slice(segs, level + 1, 1 << 20), "/").alias("shape"))
        g = table(parts.filter("branch IS NOT NULL").groupBy("host", "parent", "branch", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")]), "branches")
        # how many branches a shape is the commonest of does not matter: one row for each branch
        kinds = table(g.groupBy("host", "parent", "branch").agg(F.max(F.struct("n", "shape"))["shape"].alias("kind"), F.sum("n").alias("pages")), "kinds")
        g = table(_by_key(g, kinds, ["host", "parent", "branch"], total, "pages"), "branches")
        family = ["host", "parent", "kind"]
        shapes = table(g.groupBy(*family, "shape").agg(F.sum("n").alias("ns")), "shapes")
        pools = g.groupBy(*family).agg(F.sum("n").alias("nn"), F.sum("bad").alias("bb"), F.sum("labelled").alias("ll"))
        n_shapes = shapes.groupBy(*family).agg(F.count(F.lit(1)).alias("k"))
        pools = table(pools.join(n_shapes, family), "pools")
        per = _by_key(g, shapes, [*family, "shape"], total, "ns")
        of = per.groupBy(*family, "branch").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")], F.sum(F.col("n").cast("double") * F.col("n") / F.col("ns")).alias("x"))
        met = _by_key(of, pools, family, total, "nn")
        n, bad, labelled, nn, bb, ll = (F.col(c).cast("double") for c in ("n", "bad", "labelled", "nn", "bb", "ll"))
        chi = F.col("x") * nn / n - n
        spread = F.round(chi, 6) <= F.round((F.col("k") - 1) + SPREAD * F.sqrt(2.0 * (F.col("k") - 1)), 6)
        off = bad * ll - bb * labelled
        even = off * off <= SIMILAR * bb * (ll - bb) * labelled
        like = table(met.filter(spread & even).select(*family, "branch", "n"), "like")
        several = like.groupBy(*family).agg(F.count(F.lit(1)).alias("like"), F.min("branch").alias("first"), F.sum("n").alias("all_like")).filter("like > 1")
        joined = table(_by_key(like, table(several, "several"), family, total, "all_like").select("host", "parent", "branch", "first"), "joined")
        few = joined.count() <= BROADCAST_ROWS
        parts = parts.join(F.broadcast(joined) if few else joined.hint("merge"), ["host", "parent", "branch"], "left")
        new = F.concat(F.when(F.col("parent") == "", "/").otherwise(F.concat(F.lit("/"), "parent", F.lit("/"))), F.lit("<~"), F.col("first"), F.lit(">"), F.when(F.col("shape") == "", "").otherwise(F.concat(F.lit("/"), "shape")))
        now = table(parts.withColumn("merged", F.when(F.col("first").isNotNull(), new).otherwise(F.col("merged"))).select("host", "template", "n", "bad", "labelled", "merged"), "merged")
    return now


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row.

    A rule's verdict holds wherever a rule fits; rules are few (they are part of the plan).
    Other pages get their template's verdict. labels(page_id, bad boolean) are the labelled
    pages; without it the rules label the pages they fit. A null url or one without '://'
    has an empty host and path, is labelled by no rule and is allowed unless its (empty)
    template is rejected. Rows with a null or repeated id are rows like others (a label
    counts for each). Extra columns are ignored; an empty table gives an empty result."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "says": says, "raw": raw_path(F.col("path"))})
    if labels is None:
        marked = p.withColumn("bad", F.col("says") == "block")
    else:
        own = labels.groupBy(F.col(id_col).cast("long").alias("page_id")).agg(F.max("bad").alias("bad"))
        marked = p.join(own, "page_id", "left")
    made = len(tables_made(pages.sparkSession))
    counts = table(marked.groupBy("host", "raw").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad"), F.count("bad").alias("labelled")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    tree = table(templates(counts), "templates")
    leaves = table(tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")]), "leaves")
    of_leaf = merged(leaves, total)
    x, y, z = PURITY
    sums = of_leaf.groupBy("host", "merged").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "labelled")])
    rejects = (x * F.col("all_bad") >= y * (F.col("all_labelled") + z)) & (2 * F.col("all_labelled") >= F.col("all_n"))
    final = table(_by_key(of_leaf.select("host", "template", "merged", "n"), table(sums.select("host", "merged", "all_n", rejects.alias("rejected")), "sums"), ["host", "merged"], total, "all_n").select("host", "template", "merged", "rejected", F.col("n").alias("pages")), "final")
    found = last_table(_by_key(tree.select("host", "raw", "template", "n"), final, ["host", "template"], total, "pages").select("host", "raw", F.col("merged").alias("template"), "rejected", "n"), "found", made)
    joined = _by_key(p, found, ["host", "raw"], total, "n")
    verdict = F.coalesce("says", F.when(F.col("rejected"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def op7(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql(rules=RULES, levels: int = 6) -> str:
    """The same in DuckDB SQL, for trees of `levels` levels at most (the given urls have two)."""
    fits = [(v, h, p, f"((host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}'))") for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{h + p}'" for _, h, p, c in fits) + " END"
    says = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, _, _, c in fits) + " END"
    sql = rf"""
        WITH u AS (
            SELECT page_id, url,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages
        ), p AS (SELECT *, {rule} AS rule, {says} AS says, array_to_string([CASE WHEN prefix(s, '<') THEN chr(92) || s ELSE s END FOR s IN string_split(path, '/') IF s <> ''], '/') AS raw FROM u),
        c0 AS (SELECT host, raw, count(*) AS n, count(*) FILTER (WHERE says = 'block') AS bad, count(says) AS labelled FROM p GROUP BY host, raw),
        t0 AS (SELECT *, '' AS template, [s FOR s IN string_split(raw, '/') IF s <> ''] AS segs, true AS open FROM c0)"""
    for k in range(1, levels + 1):
        rare = f"(m < {LEAST} OR {SHARE} * m < at_node)"
        sql += f""",
        ch{k} AS (SELECT host, template, segs[{k}] AS seg, sum(n) AS m, sum(sum(n)) OVER (PARTITION BY host, template) AS at_node FROM t{k - 1} WHERE open AND len(segs) >= {k} GROUP BY host, template, segs[{k}]),
        nd{k} AS (SELECT host, template, max(at_node) < {LEAST} AS few, count(*) FILTER (WHERE {rare}) >= {CHILDREN}
                  AND (count(*) FILTER (WHERE {rare}) >= {MANY} OR sum(m) FILTER (WHERE {rare}) <= {LEAST} * count(*) FILTER (WHERE {rare}))
                  AND round(log2(CAST(sum(m) FILTER (WHERE {rare}) AS DOUBLE)) - sum(m * log2(CAST(m AS DOUBLE))) FILTER (WHERE {rare}) / sum(m) FILTER (WHERE {rare}), 6)
                      >= round({1 - LACK} * log2(CAST(nullif(count(*) FILTER (WHERE {rare}), 0) AS DOUBLE)), 6) AS wide,
                  coalesce(list(seg) FILTER (WHERE NOT {rare}), []) AS named FROM ch{k} GROUP BY host, template),
        t{k} AS (SELECT t.host, t.raw, t.n, t.bad, t.labelled,
                 CASE WHEN t.open AND len(t.segs) >= {k} THEN t.template || '/' || CASE WHEN d.few OR coalesce(d.wide, false) AND NOT list_contains(d.named, t.segs[{k}]) THEN '<*>' ELSE t.segs[{k}] END ELSE t.template END AS template,
                 t.segs, t.open AND len(t.segs) >= {k} AND NOT d.few AS open FROM t{k - 1} t LEFT JOIN nd{k} d ON t.open AND len(t.segs) >= {k} AND t.host = d.host AND t.template = d.template)"""
    sql += f""",
        m{levels + 1} AS (SELECT host, template, sum(n) AS n, sum(bad) AS bad, sum(labelled) AS labelled, template AS merged FROM t{levels} GROUP BY host, template)"""
    for k in range(levels, 0, -1):
        sql += f""",
        a{k} AS (SELECT *, array_to_string(sg[1:{k - 1}], '/') AS parent, sg[{k}] AS branch, array_to_string(sg[{k + 1}:], '/') AS shape FROM (SELECT *, [s FOR s IN string_split(merged, '/') IF s <> ''] AS sg FROM m{k + 1})),
        h{k} AS (SELECT host, parent, branch, shape, sum(n) AS n, sum(bad) AS bad, sum(labelled) AS labelled FROM a{k} WHERE branch IS NOT NULL GROUP BY host, parent, branch, shape),
        g{k} AS (SELECT *, max({{'n': n, 's': shape}}) OVER (PARTITION BY host, parent, branch).s AS kind FROM h{k}),
        s{k} AS (SELECT host, parent, kind, shape, sum(n) AS ns FROM g{k} GROUP BY host, parent, kind, shape),
        q{k} AS (SELECT host, parent, kind, sum(n) AS nn, sum(bad) AS bb, sum(labelled) AS ll, count(DISTINCT shape) AS k FROM g{k} GROUP BY host, parent, kind),
        o{k} AS (SELECT host, parent, kind, branch, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, CAST(sum(labelled) AS DOUBLE) AS labelled, sum(CAST(n AS DOUBLE) * n / ns) AS x FROM g{k} JOIN s{k} USING (host, parent, kind, shape) GROUP BY host, parent, kind, branch),
        l{k} AS (SELECT host, parent, kind, branch FROM o{k} JOIN q{k} USING (host, parent, kind) WHERE round(x * nn / n - n, 6) <= round((k - 1) + {SPREAD} * sqrt(2.0 * (k - 1)), 6)
                 AND (bad * ll - bb * labelled) * (bad * ll - bb * labelled) <= {SIMILAR} * CAST(bb AS DOUBLE) * CAST(ll - bb AS DOUBLE) * labelled),
        j{k} AS (SELECT host, parent, branch, CASE WHEN count(*) OVER w > 1 THEN min(branch) OVER w END AS first FROM l{k} WINDOW w AS (PARTITION BY host, parent, kind)),
        m{k} AS (SELECT a.host, a.template, a.n, a.bad, a.labelled, CASE WHEN j.first IS NOT NULL THEN CASE WHEN parent = '' THEN '/' ELSE '/' || parent || '/' END || '<~' || j.first || '>' || CASE WHEN shape = '' THEN '' ELSE '/' || shape END ELSE merged END AS merged
                 FROM a{k} a LEFT JOIN j{k} j USING (host, parent, branch))"""
    x, y, z = PURITY
    return sql + f""",
        om AS (SELECT host, merged, {x} * sum(bad) >= {y} * (sum(labelled) + {z}) AND 2 * sum(labelled) >= sum(n) AS rejected FROM m1 GROUP BY host, merged),
        fin AS (SELECT t.host, t.raw, om.rejected FROM t{levels} t JOIN m1 USING (host, template) JOIN om ON m1.host = om.host AND m1.merged = om.merged)
        SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.says, CASE WHEN fin.rejected THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN fin ON p.host = fin.host AND p.raw = fin.raw
    """

"""DuckDB SQL of the structural pipeline, as common table expressions over nodes, edges, adj."""

from __future__ import annotations

from ..functions.hashing import sql


def distances(most: int) -> str:
    parts = ["d0 AS (SELECT graph_id, node_id AS root, node_id AS node, 0 AS d FROM nodes)"]
    for k in range(1, most + 1):
        seen = " UNION ALL ".join(f"SELECT graph_id, root, node FROM d{i}" for i in range(k))
        parts.append(f"d{k} AS (SELECT DISTINCT f.graph_id, f.root, a.dst AS node, {k} AS d FROM d{k - 1} f JOIN adj a ON f.graph_id = a.graph_id AND f.node = a.src ANTI JOIN ({seen}) s ON s.graph_id = f.graph_id AND s.root = f.root AND s.node = a.dst)")
    parts.append("dist AS (" + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(most + 1)) + ")")
    return ", ".join(parts)


CODES = f"""
    lc AS (SELECT graph_id, node_id, {sql.code('label')} AS lh FROM nodes),
    nb AS (SELECT a.graph_id, a.src AS node_id, list({sql.sequence_code('l.lh', sql.code('a.label'))}) AS codes FROM adj a JOIN lc l ON a.graph_id = l.graph_id AND a.dst = l.node_id GROUP BY a.graph_id, a.src),
    nc AS (SELECT l.graph_id, l.node_id, l.lh, {sql.sequence_code('l.lh', sql.set_code('coalesce(b.codes, [])'))} AS nh FROM lc l LEFT JOIN nb b ON l.graph_id = b.graph_id AND l.node_id = b.node_id),
    tr AS (SELECT e.graph_id, e.u, e.v, {sql.set_code('[a.lh, ' + sql.code('e.label') + ', b.lh]')} AS triplet FROM edges e JOIN lc a ON e.graph_id = a.graph_id AND e.u = a.node_id JOIN lc b ON e.graph_id = b.graph_id AND e.v = b.node_id),
    dg AS (SELECT n.graph_id, n.node_id, coalesce(sum(CASE WHEN a.src = a.dst THEN 2 ELSE 1 END) FILTER (WHERE a.src IS NOT NULL), 0) AS degree, count(a.src) AS neighbours FROM nodes n LEFT JOIN adj a ON n.graph_id = a.graph_id AND n.node_id = a.src GROUP BY n.graph_id, n.node_id)"""


def rooted(cutoff: int, degree_threshold: int | None = None) -> str:
    limit = f"JOIN dg ON dg.graph_id = s.graph_id AND dg.node_id = s.root WHERE s.d = 0 OR dg.neighbours <= {degree_threshold}" if degree_threshold is not None else ""
    shell = sql.set_code("list(CASE WHEN d.d = 0 THEN nc.lh ELSE nc.nh END)")
    return f"""
    sh AS (SELECT d.graph_id, d.root, d.d, {shell} AS shell FROM dist d JOIN nc ON d.graph_id = nc.graph_id AND d.node = nc.node_id WHERE d.d <= {cutoff} GROUP BY d.graph_id, d.root, d.d),
    sl AS (SELECT graph_id, root, d, list(shell) OVER (PARTITION BY graph_id, root ORDER BY d ROWS UNBOUNDED PRECEDING) AS shells FROM sh),
    mc AS (SELECT s.graph_id, s.root, s.d, {sql.list_code('s.shells')} AS c FROM sl s {limit}),
    rc AS (SELECT n.graph_id, n.node_id, r.r, coalesce(mc.c, 0) AS c FROM nodes n CROSS JOIN (SELECT CAST(unnest(range(0, {cutoff + 1})) AS INTEGER) AS r) r
           LEFT JOIN mc ON mc.graph_id = n.graph_id AND mc.root = n.node_id AND mc.d = r.r)"""


PATHS = """
    pn AS (SELECT a.graph_id, a.root, st.node AS target, a.node, a.d FROM dist a JOIN dist b ON a.graph_id = b.graph_id AND a.node = b.root
           JOIN dist st ON st.graph_id = a.graph_id AND st.root = a.root AND st.node = b.node AND a.d + b.d = st.d)"""


def connectors(connector: int) -> str:
    parts = [PATHS]
    for k in range(1, connector + 1):
        parts.append(f"uc{k} AS (SELECT p.graph_id, p.root, p.target, {sql.set_code('list(' + sql.sequence_code('p.d', 'rc.c') + ')')} AS uc FROM pn p JOIN rc ON p.graph_id = rc.graph_id AND p.node = rc.node_id AND rc.r = {k - 1} GROUP BY p.graph_id, p.root, p.target)")
    return ", ".join(parts)


def raw(distance: int, connector: int = 0, use_edges: bool = True) -> str:
    pairs = "FROM dist d JOIN rc a ON d.graph_id = a.graph_id AND d.root = a.node_id JOIN rc b ON d.graph_id = b.graph_id AND d.node = b.node_id"
    arms = [f"SELECT d.graph_id, d.root AS node_id, d.d, {sql.sequence_code('a.c', 'd.d', 'b.c')} AS raw {pairs} WHERE d.d <= {distance}"]
    for k in range(1, connector + 1):
        arms.append(f"SELECT d.graph_id, d.root, d.d, {sql.sequence_code('a.c', 'd.d', 'b.c', 'x.uc')} {pairs} JOIN uc{k} x ON x.graph_id = d.graph_id AND x.root = d.root AND x.target = d.node WHERE d.d <= {distance}")
    if use_edges:
        both = "(SELECT graph_id, u AS target, triplet FROM tr UNION ALL SELECT graph_id, v, triplet FROM tr WHERE u <> v)"
        arms.append(f"SELECT d.graph_id, d.root, d.d, {sql.sequence_code('d.d', 't.triplet')} FROM dist d JOIN {both} t ON d.graph_id = t.graph_id AND d.node = t.target WHERE d.d <= {distance}")
    return "rw AS (" + " UNION ALL ".join(arms) + ")"


def features(base: str, radius: int, distance: int, connector: int = 0, nbits: int = 10, degree_threshold: int | None = None, sigma: float | None = None, use_edges: bool = True, per_graph: bool = False) -> str:
    cutoff = max(radius, connector)
    ctes = [base, CODES, distances(max(distance, cutoff)), rooted(cutoff, degree_threshold)]
    if connector:
        ctes.append(connectors(connector))
    ctes.append(raw(distance, connector, use_edges))
    key = "graph_id" if per_graph else "graph_id, node_id"
    value, kind = ("count(*)", "BIGINT") if sigma is None else (f"sum(exp(-(d * d) / {float(sigma) ** 2!r}))", "DOUBLE")
    return f"""WITH {', '.join(ctes)},
        al AS (
            SELECT {key}, {sql.feature_id('raw', nbits)} AS feature_id, CAST({value} AS {kind}) AS value FROM rw GROUP BY {key}, feature_id
            UNION ALL SELECT {key}, 0, CAST({'count(*)' if per_graph else '1'} AS {kind}) FROM nodes {'GROUP BY graph_id' if per_graph else ''}
            UNION ALL SELECT {key}, 1, CAST({'sum(degree)' if per_graph else 'degree'} AS {kind}) FROM dg {'GROUP BY graph_id' if per_graph else ''}
        )
        SELECT {key}, feature_id, {'round(value, 6) AS value' if sigma is not None else 'value'} FROM al WHERE value <> 0"""


def provenance(base: str, radius: int, distance: int, connector: int = 0, nbits: int = 10) -> str:
    """Every occurrence with the nodes and edges that it covers, as lists."""
    cutoff = max(radius, connector)
    union = "list_sort(list_distinct(list_concat({}, {})))"
    inside = "[e FOR e IN es IF list_contains({0}, e.u) AND list_contains({0}, e.v)]"
    ctes = [base, CODES, distances(distance + cutoff), f"dn AS (SELECT * FROM dist WHERE d <= {distance})", rooted(cutoff), connectors(connector).replace("JOIN dist st", "JOIN dn st")]
    ctes.append(f"""
        bl AS (SELECT graph_id, root AS node, r.r, list(node) AS members FROM dist JOIN (SELECT unnest(range(0, {cutoff + 1})) AS r) r ON d <= r.r GROUP BY graph_id, root, r.r),
        le AS (SELECT a.graph_id, a.root, list({{'u': e.u, 'v': e.v}}) AS es FROM dist a JOIN edges e ON a.graph_id = e.graph_id AND a.node = e.u JOIN dist b ON b.graph_id = e.graph_id AND b.root = a.root AND b.node = e.v GROUP BY a.graph_id, a.root),
        pl AS (SELECT graph_id, root, target, list(node) AS pns FROM pn GROUP BY graph_id, root, target),
        pe AS (SELECT a.graph_id, a.root, st.node AS target, list(DISTINCT {{'u': least(j.src, j.dst), 'v': greatest(j.src, j.dst)}}) AS pes FROM dn a JOIN adj j ON a.graph_id = j.graph_id AND a.node = j.src JOIN dn b ON b.graph_id = j.graph_id AND b.root = j.dst
               JOIN dn st ON st.graph_id = a.graph_id AND st.root = a.root AND st.node = b.node AND a.d + 1 + b.d = st.d GROUP BY a.graph_id, a.root, st.node),
        pr AS (SELECT d.graph_id, d.root, d.node AS target, d.d, a.r AS i, b.r AS j, a.c AS ca, b.c AS cb, {union.format('x.members', 'y.members')} AS ns, coalesce(le.es, []) AS es
               FROM dn d JOIN rc a ON d.graph_id = a.graph_id AND d.root = a.node_id JOIN rc b ON d.graph_id = b.graph_id AND d.node = b.node_id
               JOIN bl x ON x.graph_id = d.graph_id AND x.node = d.root AND x.r = a.r JOIN bl y ON y.graph_id = d.graph_id AND y.node = d.node AND y.r = b.r LEFT JOIN le ON le.graph_id = d.graph_id AND le.root = d.root)""")
    arms = [f"SELECT {sql.sequence_code('ca', 'd', 'cb')} AS raw, 'paired_rooted_subgraph' AS kind, graph_id, root, target, ns, list_sort({inside.format('ns')}) AS es FROM pr"]
    for k in range(1, connector + 1):
        ctes.append(f"cn{k} AS (SELECT p.graph_id, p.root, p.target, list(DISTINCT q.node) AS cns FROM pn p JOIN dist q ON q.graph_id = p.graph_id AND q.root = p.node AND q.d <= {k - 1} GROUP BY p.graph_id, p.root, p.target)")
        edges = union.format(inside.format("ns"), f"list_concat({inside.format('cns')}, coalesce(pes, []))")
        arms.append(f"SELECT {sql.sequence_code('ca', 'd', 'cb', 'uc')}, 'paired_rooted_subgraph', graph_id, root, target, {union.format('ns', 'cns')}, {edges} FROM pr JOIN uc{k} USING (graph_id, root, target) JOIN cn{k} USING (graph_id, root, target) LEFT JOIN pe USING (graph_id, root, target)")
    arms.append(f"""SELECT {sql.sequence_code('d', 'triplet')}, 'edge_triplet', graph_id, root, target, {union.format('pns', '[target, other]')}, {union.format('coalesce(pes, [])', "[{'u': least(target, other), 'v': greatest(target, other)}]")}
        FROM (SELECT d.graph_id, d.root, d.node AS target, d.d, t.other, t.triplet FROM dn d JOIN (SELECT graph_id, u AS target, v AS other, triplet FROM tr UNION ALL SELECT graph_id, v, u, triplet FROM tr WHERE u <> v) t ON d.graph_id = t.graph_id AND d.node = t.target)
        JOIN pl USING (graph_id, root, target) LEFT JOIN pe USING (graph_id, root, target)""")
    ctes.append("oc AS (" + " UNION ALL ".join(arms) + ")")
    return f"WITH {', '.join(ctes)} SELECT {sql.feature_id('raw', nbits)} AS feature_id, raw AS raw_signature, kind AS feature_kind, graph_id, root AS root_node, target AS target_node, ns AS source_node_ids, es AS source_edge_ids FROM oc"

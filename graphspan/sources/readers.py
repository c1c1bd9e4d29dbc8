"""Sources by uri and type: lines of molecules, SD files, tensor files, readers of your own;
and loading with offset, limit and balancing."""

from __future__ import annotations

import io
import sys
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import islice
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import selection
from ..operators.selection import ranked
from ..plans.ship import ship_code
from ..plans.storage import cut
from .tables import Graphs

#: What a parser gives for one molecule: node labels, and edges as (u, v, label); None if unreadable.
Parsed = tuple[list[str], list[tuple[int, int, str]]] | None


def cells(line: Column) -> Column:
    """Cells of a line: of a row with commas (quotes respected, cells trimmed), else its words.
    Null for blank lines and those that begin with #."""
    s = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    outside = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    row = F.transform(F.split(s, outside), lambda c: F.trim(F.when(F.trim(c).rlike('^".*"$'), F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)))
    return F.when((s == "") | s.startswith("#"), F.lit(None)).when(s.contains(","), row).otherwise(F.split(s, r"\s+"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_uri, source_line, value), lines from 1 in each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_uri"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"), "value")
    return ranked(lines, ["source_uri"], ["__at", "__id"], "__n").select("source_uri", (F.col("__n") + 1).alias("source_line"), "value")


#: Lines of a file in one block of parse_lines.
BLOCK_LINES = 100_000


def parse_lines(lines: DataFrame) -> DataFrame:
    """(source_uri, source_line, smiles, name, props) of all lines but blank ones, comments and
    headers. A header (first cell `smiles`, any case) names the cells of the lines below it
    up to the next; a second cell is the name. Headers are carried on within blocks of lines,
    and from block to block, so no file need fit one task."""
    c = lines.select("source_uri", "source_line", cells(F.col("value")).alias("c")).filter("c IS NOT NULL")
    head = F.when(F.lower(F.element_at("c", 1)) == "smiles", F.col("c"))
    c = c.withColumn("h", head).withColumn("block", F.floor(F.col("source_line") / BLOCK_LINES))
    blocks = c.groupBy("source_uri", "block").agg(F.max(F.when(F.col("h").isNotNull(), F.struct("source_line", "h")))["h"].alias("last_head"))
    before = Window.partitionBy("source_uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carried", F.last("last_head", ignorenulls=True).over(before)).filter("carried IS NOT NULL").select(F.col("source_uri").alias("__uri"), F.col("block").alias("__block"), "carried")
    so_far = Window.partitionBy("source_uri", "block").orderBy("source_line").rowsBetween(Window.unboundedPreceding, 0)
    met = c.withColumn("own", F.last("h", ignorenulls=True).over(so_far)).filter("h IS NULL")
    last = met.join(carried, (F.col("source_uri") == F.col("__uri")) & (F.col("block") == F.col("__block")), "left").select("source_uri", "source_line", "c", F.coalesce("own", "carried").alias("h"))
    n = F.least(F.size("h"), F.size("c"))
    pairs = F.filter(F.arrays_zip(F.slice("h", 2, F.greatest(n - 1, F.lit(0))).alias("k"), F.slice("c", 2, F.greatest(n - 1, F.lit(0))).alias("v")), lambda p: p["k"] != "")
    # of repeated names the last counts
    props = F.when(F.col("h").isNotNull(), F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))))
    second = F.when(F.size("c") > 1, F.element_at("c", 2))
    return last.select("source_uri", "source_line", F.element_at("c", 1).alias("smiles"), F.when(second != "", second).alias("name"), props.alias("props"))


# --- records: what every reader gives ---


@dataclass
class GraphRecord:
    """One graph of a reader: labels of nodes 0, 1, ...; edges (u, v, label); attributes."""

    labels: list
    edges: list = field(default_factory=list)
    name: str | None = None
    props: dict = field(default_factory=dict)
    attrs: list | None = None
    edge_attrs: list | None = None
    weights: list | None = None


#: One row for each graph; ok is false for what could not be read.
RECORD = """source_uri string, source_line long, name string, props map<string, string>, ok boolean,
    nodes array<struct<node_id: long, label: string, attr: array<double>, weight: double>>, edges array<struct<u: long, v: long, label: string, attr: array<double>>>"""


def hashable(value):
    """Arrays and lists as tuples, mappings as sorted tuples of items, however deep."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return tuple(sorted((k, hashable(v)) for k, v in value.items()))
    return tuple(map(hashable, value)) if isinstance(value, list | tuple) else value


def validated(record) -> GraphRecord:
    if not isinstance(record, GraphRecord):
        raise TypeError(f"readers give GraphRecord, not {type(record).__name__}")
    return record


def _label(value) -> str:
    return "0" if value is None else str(hashable(value))


def _row(uri: str, line: int, r: GraphRecord | None) -> dict:
    if r is None:
        return {"source_uri": uri, "source_line": line, "name": None, "props": {}, "ok": False, "nodes": [], "edges": []}

    def floats(x, i):
        return None if x is None or x[i] is None else [float(v) for v in hashable(x[i])]

    nodes = [{"node_id": i, "label": _label(v), "attr": floats(r.attrs, i), "weight": None if r.weights is None else float(r.weights[i])} for i, v in enumerate(r.labels)]
    edges = {}  # an edge given twice, or from both ends, counts once
    for i, (u, v, label) in enumerate(r.edges):
        edges.setdefault((min(u, v), max(u, v)), {"u": int(min(u, v)), "v": int(max(u, v)), "label": _label(label), "attr": floats(r.edge_attrs, i)})
    props = {str(k): str(v) for k, v in r.props.items()}
    return {"source_uri": uri, "source_line": line, "name": None if r.name is None else str(r.name), "props": props, "ok": True, "nodes": nodes, "edges": list(edges.values())}


def _rows_frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source_uri", "source_line", "name", "props", "ok", "nodes", "edges"])


#: Graphs in one frame between a reader and Spark.
_FRAME = 256


def from_reader(spark: SparkSession, uris: str | list[str], reader: Callable[[str], Iterable[GraphRecord]]) -> DataFrame:
    """RECORD rows of reader(uri), which runs where Spark puts it, one task for each uri. What
    it gives is checked; its graphs are numbered from 1."""
    if not callable(reader):
        raise TypeError("a reader is called with a uri")
    ship_code(spark)
    names = [uris] if isinstance(uris, str) else list(uris)
    rows = spark.createDataFrame([(i, str(u)) for i, u in enumerate(names)], "i long, uri string").repartition(max(1, len(names)), "i")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri in f["uri"]:
                held = []
                for n, record in enumerate(reader(uri), 1):
                    held.append(_row(uri, n, None if record is None else validated(record)))
                    if len(held) == _FRAME:
                        yield _rows_frame(held)
                        held = []
                yield _rows_frame(held)

    return rows.mapInPandas(run, RECORD)


def _parsed(rows: DataFrame, parse: Callable[[str], Parsed | GraphRecord], text: str) -> DataFrame:
    """RECORD rows of (source_uri, source_line, name, props, text)."""
    ship_code(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for uri, line, name, props, value in zip(*(f[c] for c in ("source_uri", "source_line", "name", "props", text)), strict=True):
                made = parse(value)
                record = made if made is None or isinstance(made, GraphRecord) else GraphRecord(list(made[0]), list(made[1]))
                if record is not None:
                    record.name = name if record.name is None else record.name
                    record.props = dict(props or {}) | record.props
                out.append(_row(uri, int(line), record))
            yield _rows_frame(out)

    return rows.select("source_uri", "source_line", "name", "props", text).mapInPandas(run, RECORD)


# --- where sources lie ---


def is_url(uri) -> bool:
    return urlparse(str(uri)).scheme in ("http", "https")


@contextmanager
def open_binary(uri):
    """A stream of bytes of a URL or a local file."""
    with urllib.request.urlopen(str(uri)) if is_url(uri) else open(uri, "rb") as stream:
        yield stream


@contextmanager
def open_text(uri, encoding: str = "utf-8"):
    with open_binary(uri) as stream, io.TextIOWrapper(stream, encoding=encoding) as text:
        yield text


def source_lines(spark: SparkSession, uri: str) -> DataFrame:
    """(source_uri, source_line, value) of what Spark can read, or of a URL, which one task
    streams."""
    if not is_url(uri):
        return numbered_lines(spark, uri)
    ship_code(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for u in f["uri"]:
                with open_text(u) as lines:
                    numbered = ((u, n, line.rstrip("\r\n")) for n, line in enumerate(lines, 1))
                    while held := list(islice(numbered, 10_000)):
                        yield pd.DataFrame(held, columns=["source_uri", "source_line", "value"])

    return spark.createDataFrame([(str(uri),)], "uri string").mapInPandas(run, "source_uri string, source_line long, value string")


# --- molecules ---


def _chem():
    try:
        from rdkit import Chem
    except ImportError as e:
        raise ImportError("reading molecules needs the optional package RDKit") from e
    return Chem


def _of_molecule(mol) -> Parsed:
    if mol is None:
        return None
    atoms = [str((a.GetAtomicNum(), a.GetFormalCharge(), str(a.GetChiralTag()), a.GetTotalNumHs(), str(a.GetHybridization()), a.GetIsAromatic())) for a in mol.GetAtoms()]
    return atoms, [(b.GetBeginAtomIdx(), b.GetEndAtomIdx(), str((str(b.GetBondType()), str(b.GetStereo()), b.GetIsConjugated(), b.IsInRing()))) for b in mol.GetBonds()]


def _rdkit(text: str) -> Parsed:
    return _of_molecule(_chem().MolFromSmiles(text))


def _rdkit_block(text: str) -> Parsed:
    return _of_molecule(_chem().MolFromMolBlock(text))


def plain_block(text: str) -> Parsed:
    """Elements and bond orders of a V2000 molecule block, without a chemistry package; None
    if the block is broken."""
    lines = text.splitlines()
    try:
        n_atoms, n_bonds = int(lines[3][:3]), int(lines[3][3:6])
        atoms = [line[31:34].strip() for line in lines[4 : 4 + n_atoms]]
        bonds = [(int(line[:3]) - 1, int(line[3:6]) - 1, str(int(line[6:9]))) for line in lines[4 + n_atoms : 4 + n_atoms + n_bonds]]
    except (IndexError, ValueError):
        return None
    fine = len(atoms) == n_atoms and len(bonds) == n_bonds and all(atoms) and all(0 <= u < n_atoms and 0 <= v < n_atoms for u, v, _ in bonds)
    return (atoms, bonds) if fine else None


def read_smiles(spark: SparkSession, uri: str, parse: Callable | None = None) -> DataFrame:
    rows = parse_lines(source_lines(spark, uri)).withColumn("props", F.map_concat(F.coalesce("props", F.create_map().cast("map<string,string>")), F.create_map(F.lit("smiles"), "smiles")))
    return _parsed(rows, parse or _rdkit, "smiles")


def sdf_records(spark: SparkSession, uri: str) -> DataFrame:
    """(source_uri, source_line: number in its file, name, props, block) of the molecules of SD
    files. A record ends at a line of four dollars; its first line is the name, and data items
    follow the block."""
    if is_url(uri):
        whole = source_lines(spark, uri).groupBy("source_uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_line", "value"))), lambda x: x["value"]), "\n").alias("text"))
        parts = whole.select("source_uri", F.posexplode(F.split("text", r"\$\$\$\$\r?(?:\n|$)")).alias("n", "text")).select("source_uri", F.lit(0).alias("at"), "n", "text")
    else:
        parts = spark.read.option("lineSep", "$$$$").text(uri).select(F.col("_metadata.file_path").alias("source_uri"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"^\r?\n", "").alias("text"))
    kept = ranked(parts.filter(F.length(F.trim(F.regexp_replace("text", r"\s", ""))) > 0), ["source_uri"], ["at", "n"], "place")
    items = F.regexp_extract_all("text", F.lit(r"(?m)^>[^\n<]*<([^>\n]*)>[^\n]*\n([^\n]*)"), 0)
    pairs = F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^>[^\n<]*<([^>\n]*)>", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(x, r"\n([^\n]*)$", 1), r"\r$", "")).alias("v")))
    once = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    name = F.trim(F.regexp_extract("text", r"^([^\r\n]*)", 1))
    return kept.select("source_uri", (F.col("place") + 1).alias("source_line"), F.when(name != "", name).alias("name"), F.map_from_entries(once).alias("props"), F.col("text").alias("block"))


def read_sdf(spark: SparkSession, uri: str, parse: Callable | None = None) -> DataFrame:
    return _parsed(sdf_records(spark, uri), parse or _rdkit_block, "block")


# --- tensors ---


def _torch():
    try:
        import torch
        from torch_geometric.data import Batch, Data
    except ImportError as e:
        raise ImportError("reading tensor files needs the optional packages PyTorch and PyTorch Geometric") from e
    return torch, Data, Batch


def of_tensors(data) -> GraphRecord:
    """The graph of an object with num_nodes, edge_index and attributes by name: node labels are
    `label`, else `x`, else 0; edge labels `label`'s (one for each edge), else `edge_attr`, else 0."""
    names = list(data.keys() if callable(data.keys) else data.keys)
    of_nodes = {k: hashable(getattr(data, k)) for k in names if k not in ("batch", "ptr") and data.is_node_attr(k)}
    of_edges = {k: hashable(getattr(data, k)) for k in names if k != "edge_index" and data.is_edge_attr(k)}
    n, (us, vs) = int(data.num_nodes), hashable(data.edge_index)
    labels = list(of_nodes.get("label", of_nodes.get("x", [0] * n)))
    edges = of_edges.get("label", of_edges.get("edge_attr", [0] * len(us)))
    return GraphRecord(labels, list(zip(us, vs, edges, strict=True)))


def _tensor_reader(uri: str) -> Iterator[GraphRecord]:
    torch, data_type, batch_type = _torch()
    with open_binary(uri) as stream:
        held = torch.load(io.BytesIO(stream.read()), map_location="cpu")
    held = held.to_data_list() if isinstance(held, batch_type) else [held] if isinstance(held, data_type) else held
    if not isinstance(held, Iterable):
        raise TypeError("a tensor file holds one graph, a batch or several graphs")
    for data in held:
        if not isinstance(data, data_type):
            raise TypeError(f"a tensor file holds graphs, not {type(data).__name__}")
        yield of_tensors(data)


def read_tensors(spark: SparkSession, uri: str, parse: Callable | None = None) -> DataFrame:
    return from_reader(spark, uri, _tensor_reader)


#: Readers by type: (spark, uri, parser or None) to RECORD rows.
READERS: dict[str, Callable[[SparkSession, str, Callable | None], DataFrame]] = {"smiles": read_smiles, "sdf": read_sdf, "pyg_pt": read_tensors}


def reader(kind: str) -> Callable[[SparkSession, str, Callable | None], DataFrame]:
    found = READERS.get(str(kind).strip().lower())
    if found is None:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(sorted(READERS))}")
    return found


# --- loading ---


@dataclass
class Loaded:
    """Graphs, and an index of them (graph_id, seq, name, source_uri, source_line, props).
    class_weight and the rest of `balance` are there after balanced loading."""

    graphs: Graphs
    index: DataFrame
    seen: int | None = None
    errors: int = 0
    candidate_size: int | None = None
    class_weight: DataFrame | None = None


def label_of(index: DataFrame, label=None) -> Column:
    """A label for each row of an index: a column's name, a column, or a function of the index;
    by default the name."""
    if label is None:
        return F.col("name")
    if isinstance(label, str):
        return F.col(label)
    if isinstance(label, Column):
        return label
    if callable(label):
        return label(index)
    raise TypeError("a label is a column, its name or a function of the index")


def stream_stats(loaded: int, errors: int, seconds: float) -> str:
    seconds = max(seconds, 1e-12)
    return f"seen={loaded} loaded={loaded} errors={errors} elapsed={seconds:.2f}s graphs/sec={loaded / seconds:.2f} sec/graph={seconds / loaded if loaded else float('nan'):.6f}"


def load(spark: SparkSession, uri, kind: str | None = None, reader_of: Callable | None = None, parse: Callable | None = None, limit=None, start_after: int = 0, seed: int = 0, balance: bool = False, label=None, verbose: bool = False, mode: str = "load") -> Loaded:
    """Graphs of a source: by type, or by a reader of your own (called with the uri; the type is
    not looked at then). What cannot be read counts as an error and is left out; then come the
    offset, the limit (a number, or a share of the rest) and balancing, as in `selected`."""
    began = time.perf_counter()
    selection.check_limit(limit)
    selection.check_count("start_after_instance", start_after)
    rows = cut(from_reader(spark, uri, reader_of) if reader_of is not None else reader(kind)(spark, uri, parse))
    errors = rows.filter("NOT ok").count()
    placed = cut(selection.ranked(rows.filter("ok").drop("ok"), [], ["source_uri", "source_line"], "seq").withColumn("graph_id", F.col("seq")))
    nodes = placed.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.*")
    edges = placed.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.*")
    index = placed.select("graph_id", "seq", "name", "source_uri", "source_line", "props")
    out = selected(Loaded(Graphs(nodes, edges), index, errors=errors), limit, start_after, seed, balance, label)
    out.seen = out.index.count()
    if verbose:
        print(f"[{mode}_from] final: {stream_stats(out.seen, errors, time.perf_counter() - began)}", file=sys.stderr, flush=True)
    return out


def selected(source: Loaded, limit=None, start_after: int = 0, seed: int = 0, balance: bool = False, label=None) -> Loaded:
    """Some of loaded graphs. A share samples before balancing; with balancing, a number is the
    balanced size, and class weights are those before balancing."""
    selection.check_limit(limit)
    whole = isinstance(limit, int)
    pool = selection.offset_limit(source.index, "seq", start_after, limit if not balance or not whole else None, seed)
    weights = size = None
    if balance:
        pool = pool.withColumn("__label", label_of(pool, label))
        weights, size = selection.class_weights(pool, "__label"), pool.count()
        pool = selection.balanced(pool, "seq", "__label", limit if whole else None, seed).drop("__label")
    ids = pool.select("graph_id")
    kept = source.graphs.only(ids)
    return Loaded(kept, pool, None, source.errors, size, weights)


def graphs_of(rows: DataFrame, parse: Callable[[str], Parsed] = _rdkit, text: str = "smiles", id_col: str = "graph_id") -> tuple[Graphs, DataFrame]:
    """Graphs of a text column, and the ids of unreadable rows. The parser must be importable
    on the executors or pickle by value."""
    plain = rows.select(F.lit("").alias("source_uri"), F.col(id_col).cast("long").alias("source_line"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("map<string,string>").alias("props"), text)
    made = cut(_parsed(plain, parse, text).withColumnRenamed("source_line", "graph_id"))
    nodes = made.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.node_id", "n.label")
    edges = made.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.u", "e.v", "e.label")
    return Graphs(nodes, edges), made.filter("NOT ok").select("graph_id")

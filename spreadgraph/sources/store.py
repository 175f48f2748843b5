"""Graphs and tables on disk: partitioned Parquet, GraphML and LaTeX exports, file listings."""

from __future__ import annotations

from collections.abc import Mapping
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadgraph.operators.graph import SpreadGraph

KEYS = ("media_type", "graph_type", "period")


def save_graph(graph: SpreadGraph, root: str, media_type: str, graph_type: str, period: str, mode: str = "overwrite") -> None:
    """Write ``vertices`` and ``edges`` below a root, one partition a graph; only that partition is replaced.

    ``mode='errorifexists'`` and 'ignore' look at that partition alone.
    """
    spark = graph.edges.sparkSession
    for name, rows in (("vertices", graph.vertices), ("edges", graph.edges)):
        path = f"{root}/{name}/" + "/".join(f"{k}={v}" for k, v in zip(KEYS, (media_type, graph_type, period), strict=True))
        if mode != "overwrite" and exists(spark, path):
            if mode == "ignore":
                continue
            raise FileExistsError(path)
        rows.write.mode("overwrite").parquet(path)


def load_graph(spark: SparkSession, root: str, **keys: str) -> SpreadGraph:
    """The vertices and edges of the graphs with the given keys; the others' folders are pruned."""
    out = []
    for name in ("vertices", "edges"):
        rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
        for k, v in keys.items():
            rows = rows.where(F.col(k) == v)
        out.append(rows)
    return SpreadGraph(*out)


def update_table(rows: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions that ``rows`` holds and keep the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "", modified_after: float | None = None) -> list[str]:
    """Names in a folder by prefix, suffix and time of change (seconds since 1970), through Spark's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    ok = lambda f: f.getPath().getName().startswith(prefix) and f.getPath().getName().endswith(suffix) and (modified_after is None or f.getModificationTime() / 1000 > modified_after)
    return sorted(f.getPath().getName() for f in found if ok(f))


def read_changed(spark: SparkSession, folder: str, after: str, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files changed after a moment (``YYYY-MM-DDTHH:MM:SS``)."""
    return spark.read.option("modifiedAfter", after).option("pathGlobFilter", pattern).parquet(folder)


def attach(spark: SparkSession, name: str, folder: str, tables: Sequence[str]) -> None:
    """Make the Parquet tables of another store known to SQL as ``<name>_<table>``."""
    for table in tables:
        spark.read.parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(f"{name}_{table}")


def write_client_map(clients: DataFrame, path: str) -> None:
    """Write a client map (``source_id, source_content``) as a table; an older one at the path is replaced whole."""
    clients.select(F.col("source_id").cast("int").alias("source_id"), "source_content").write.mode("overwrite").parquet(path)


def read_sqlite(path: str, query: str, spark: SparkSession, schema: str, attached: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a local SQLite database by a read-only query: a border for old files, read on the driver batch by batch.

    ``attached`` names further databases that the query may read; all are opened read-only.
    """
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for name, other in (attached or {}).items():
            if not name.isidentifier():
                raise ValueError(f"{name!r} can't name a database")
            db.execute(f"ATTACH ? AS {name}", (f"file:{other}?mode=ro",))
        cursor = db.execute(query)
        parts = []
        while rows := cursor.fetchmany(100_000):
            parts.append(spark.createDataFrame(rows, schema))
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


_XML_TYPES = {"bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean"}


def _attributes(rows: DataFrame, but: Sequence[str], kind: str) -> tuple[list[str], F.Column]:
    """The key lines of the columns that are no ids, and the data elements of a row; nulls have none."""
    named = [(c, t) for c, t in rows.dtypes if c not in but]
    keys = [f'<key id="{kind}_{c}" for="{kind}" attr.name="{c}" attr.type="{_XML_TYPES.get(t, "string")}"/>' for c, t in named]
    plain = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return keys, F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit(f'<data key="{kind}_{c}">'), plain(c), F.lit("</data>")), F.lit("")) for c, _ in named])


def graphml(graph: SpreadGraph) -> DataFrame:
    """``line``: the graph as GraphML text with the attributes of its vertices and edges, in order; write with ``write.text``.

    The lines are range-partitioned by part and id, so no task holds all vertices or edges.
    """
    spark = graph.edges.sparkSession
    node_keys, node_data = _attributes(graph.vertices, ["user_id"], "node")
    edge_keys, edge_data = _attributes(graph.edges, ["src", "dst"], "edge")
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(node_keys + edge_keys) + '<graph edgedefault="directed">'
    nodes = graph.vertices.select(F.concat(F.format_string('<node id="n%d">', "user_id"), node_data, F.lit("</node>")).alias("line"), F.lit(1).alias("part"), F.col("user_id").alias("id"))
    edges = graph.edges.select(F.concat(F.format_string('<edge source="n%d" target="n%d">', "src", "dst"), edge_data, F.lit("</edge>")).alias("line"), F.lit(2).alias("part"), F.col("src").alias("id"))
    ends = spark.createDataFrame([(head, 0, 0), ("</graph></graphml>", 3, 0)], "line string, part int, id long")
    return ends.unionByName(nodes).unionByName(edges).orderBy("part", "id", "line").select("line")


def latex(rows: DataFrame, decimals: Mapping[str, int] | None = None, limit: int = 1000) -> str:
    """A small table as LaTeX; more than ``limit`` rows are refused rather than cut."""
    decimals = decimals or {}
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"over {limit} rows don't belong in a LaTeX table")
    cell = lambda c, v: "" if v is None else f"{v:.{decimals.get(c, 2)}f}" if isinstance(v, float) else escape(str(v)).replace("_", r"\_").replace("&amp;", r"\&")
    lines = [r"\begin{tabular}{" + "l" * len(rows.columns) + "}", " & ".join(c.replace("_", r"\_") for c in rows.columns) + r" \\ \hline"]
    lines += [" & ".join(cell(c, r[c]) for c in rows.columns) + r" \\" for r in got]
    return "\n".join([*lines, r"\end{tabular}"])

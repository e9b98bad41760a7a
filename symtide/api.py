"""The ten tools of a code index as methods of a project, each giving DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.patterns import matches_qualified
from .operators import aliases as al
from .operators import graphs, increments, search
from .operators import relations as rel
from .operators.search import Criteria, project_only
from .session import materialize

TARGETS = ("classes", "functions", "all_symbol_types")
_PROJECT, _ALL = search.SCOPES


@dataclass
class Answer:
    """Rows, and one row on what they are: status, how many, how many in all; with a fallback if there are none."""

    rows: DataFrame
    total: int | None = None
    fallback: search.Fallback | None = None

    @property
    def status(self) -> DataFrame:
        return search.result_status(self.rows, self.total)


def file_prints(symbols: DataFrame) -> DataFrame:
    """(path, hash): the number of a file's symbols and the sum of the hashes of all their fields, so any change of any row shows."""
    fields = [F.col(c) for c in symbols.columns if c not in ("bases", "name_lc", "qualified_name_lc")]
    return symbols.groupBy(F.col("file").alias("path")).agg(F.concat_ws("/", F.count(F.lit(1)), F.sum(F.xxhash64(*fields).cast("decimal(38,0)"))).alias("hash"))


class Project:
    """An indexed project over the tables of a directory."""

    def __init__(self, spark: SparkSession, data: str):
        self.spark = spark
        self.set_project(data)

    def set_project(self, data: str) -> "Project":
        """Take the tables of ``data``; the resolved symbols and the call and inheritance edges are maintained tables in the shared folder."""
        self.data = data
        self.symbols = rel.symbols(self.spark, data)
        self.edges, self.pairs = rel.call_edges(self.spark, data), rel.call_pairs(self.spark, data)
        self.aliases = rel.aliases(self.spark, data)
        return self

    def sync_project(self, data: str | None = None, refresh_mode: str = "incremental") -> DataFrame:
        """Take in newer tables and give the files that changed; 'full' names every file."""
        old = file_prints(self.symbols)
        self.set_project(data or self.data)
        new = file_prints(self.symbols)
        return new.select("path", F.lit("refreshed").alias("change")) if refresh_mode == "full" else increments.change_set(old, new)

    @property
    def inherits(self) -> DataFrame:
        return rel.inherits(self.spark, self.data)

    # --- search
    def find_symbols_by_pattern(self, symbol_name: str = "", target_type: str = "all_symbol_types", output_detail_level: str = "full", search_scope: str = _PROJECT, file_name: str | None = None, namespace: str | None = None, max_results: int | None = None, class_name: str | None = None, signature: str | None = None) -> Answer:
        if target_type not in TARGETS:
            raise ValueError(f"target_type must be one of {TARGETS}")
        if max_results is not None and max_results < 1:
            raise ValueError("max_results must be at least 1")
        q = Criteria(symbol_name, project_only(search_scope), file_name, namespace, class_name, signature).safe()
        run = {"classes": search.search_classes, "functions": search.search_functions, "all_symbol_types": search.search_symbols}[target_type]
        every = run(self.symbols, q)
        total = every.count()
        rows = every if max_results is None else run(self.symbols, Criteria(q.pattern, q.project_only, q.file_name, q.namespace, q.class_name, q.signature, max_results))
        return Answer(search.with_detail(rows, output_detail_level), total, search.explain_empty(self.symbols, symbol_name, file_name) if not total else None)

    def find_in_file(self, file_path: str, pattern: str = "", boundary: bool = True) -> Answer:
        rows = search.find_in_file(self.symbols, file_path, Criteria(pattern).safe(), boundary)
        return Answer(rows)

    def file_suggestions(self, partial: str, k: int = 5) -> DataFrame:
        return search.path_suggestions(self.symbols.filter("file IS NOT NULL"), partial, k)

    # --- classes
    def get_class_info(self, class_name: str) -> dict[str, DataFrame]:
        """'candidates' (more than one qualified name: ambiguous), 'methods' in order of lines, 'derived' project classes."""
        found = search.class_candidates(self.symbols.filter(F.col("kind").isin(*rel.CLASS_KINDS)), class_name)
        methods = search.class_methods(self.symbols).join(found.select(F.col("usr").alias("class_usr")), "class_usr", "left_semi")
        below = self.inherits.join(found.select(F.col("usr").alias("base_usr")), "base_usr", "left_semi").select(F.col("derived_usr").alias("usr")).distinct()
        return {"candidates": found, "methods": methods.orderBy(F.coalesce("header_line", "line"), "name"), "derived": self.symbols.join(below, "usr", "left_semi").filter("is_project")}

    def get_class_hierarchy(self, class_name: str, direction: str = "both", max_nodes: int = 200, max_depth: int | None = None, output_format: str = "json") -> tuple[DataFrame, DataFrame]:
        """(nodes, one row that tells whether nodes were cut off); formats json, compact, cpp and cpp_with_meta."""
        if direction not in ("up", "down", "both"):
            raise ValueError("direction must be up, down or both")
        start = search.class_candidates(self.symbols.filter(F.col("kind").isin(*rel.CLASS_KINDS)), class_name).select(F.col("usr").alias("node"))
        top, cut = graphs.capped(graphs.hierarchy(self.inherits, start, direction, max_depth), max_nodes)
        nodes = top.join(self.symbols.select(F.col("usr").alias("node"), F.col("qualified_name").alias("name"), "kind", "is_project", "bases"), "node", "left")
        if output_format == "compact":
            return graphs.compact_json(nodes), cut
        if output_format in ("cpp", "cpp_with_meta"):
            inner = self.inherits.join(nodes.select(F.col("node").alias("derived_usr")), "derived_usr", "left_semi")
            here = nodes.select(F.col("node").alias("base_usr"), F.lit(True).alias("here"))
            inner = inner.join(here, "base_usr", "left").withColumn("base_usr", F.when(F.col("here"), F.col("base_usr")))
            return graphs.declarations(nodes.select("node", "name", "kind", "is_project"), inner, output_format == "cpp_with_meta"), cut
        return nodes, cut

    def get_type_alias_info(self, type_name: str) -> DataFrame:
        asked = self.spark.createDataFrame([(type_name,)], "name string")
        return al.alias_info(asked, self.aliases, self.symbols.filter(F.col("kind").isin(*rel.CLASS_KINDS)))

    # --- calls
    def _functions(self, name: str, class_name: str | None) -> DataFrame:
        f = self.symbols.filter(F.col("kind").isin(*rel.FUNCTION_KINDS) & matches_qualified(F.col("qualified_name"), name))
        return (f.filter(F.col("parent_class").endswith(class_name)) if class_name else f).select("usr")

    def find_incoming_calls(self, function_name: str, class_name: str | None = None, search_scope: str = _PROJECT, max_results: int | None = None) -> Answer:
        """Callers; if the project has none but others do, those come instead."""
        return self._calls("callee_usr", "caller_usr", "caller", function_name, class_name, search_scope, max_results)

    def find_outgoing_calls(self, function_name: str, class_name: str | None = None, return_format: str = "summary", search_scope: str = _PROJECT, max_results: int | None = None) -> Answer:
        """Callees, or with return_format 'call_sites' every site in order of file and line."""
        if return_format == "call_sites":
            targets = self._functions(function_name, class_name).withColumnRenamed("usr", "caller_usr")
            rows = graphs.calls_of(self.edges.join(targets, "caller_usr", "left_semi")).orderBy("file", "line", "column_no")
            return Answer(rows if max_results is None else rows.limit(max_results), rows.count())
        return self._calls("caller_usr", "callee_usr", "callee", function_name, class_name, search_scope, max_results)

    def _calls(self, here: str, there: str, what: str, name: str, class_name: str | None, scope: str, k: int | None) -> Answer:
        only = project_only(scope)
        mine = self.pairs.join(self._functions(name, class_name).withColumnRenamed("usr", here), here, "left_semi")
        every = materialize((graphs.callers if what == "caller" else graphs.callees)(mine), "calls")
        rows = graphs.project_or_all(every, here) if only else every
        total = rows.count()
        return Answer(rows if k is None else rows.orderBy(f"{what}_name", there).limit(k), total)

    def trace_execution_path(self, source_function: str, target_function: str, max_depth: int = 10) -> list[list[str]]:
        """One shortest path for each pair of functions that the two names mean, in order."""
        node = lambda n: self._functions(n, None).withColumnRenamed("usr", "node")
        got = graphs.bfs_paths(self.pairs, node(source_function), node(target_function), "caller_usr", "callee_usr", max_depth)
        return [r["path"] for r in got.orderBy("source", "target").collect()]

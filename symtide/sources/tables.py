"""Tables in: the index's own files, compile databases, logs and source trees.

Schemas are declared, never inferred from data; malformed lines are skipped or kept
aside, as each reader says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.arguments import clean_arguments, command_words
from ..session import blank

#: C++ file endings, directories that no scan enters, and those of dependencies.
CPP = (".cpp", ".cc", ".cxx", ".c++", ".h", ".hpp", ".hxx", ".h++")
EXCLUDED = (".git", ".svn", ".hg", "node_modules", "__pycache__", ".pytest_cache", ".vs", ".vscode", ".idea", "CMakeFiles", "CMakeCache.txt")
DEPENDENCIES = ("vcpkg_installed", "third_party", "ThirdParty", "external", "External", "vendor", "dependencies", "packages")
#: The largest file that is read unless asked otherwise, in MB.
MAX_MB = 10

SCHEMAS = {
    "symbols": "usr string, name string, qualified_name string, kind string, file string, line int, column_no int, signature string, is_project boolean, namespace string, access string, parent_class string, "
    "base_classes string, is_template boolean, template_kind string, start_line int, end_line int, header_file string, header_line int, is_definition boolean, is_virtual boolean, is_pure_virtual boolean, "
    "is_const boolean, is_static boolean, brief string, doc_comment string, created_at timestamp_ntz, updated_at timestamp_ntz, removed_at timestamp_ntz",
    "call_sites": "call_site_id long, caller_usr string, callee_usr string, file string, line int, column_no int, display_name string, template_project_types array<string>, created_at timestamp_ntz",
    "type_aliases": "alias_name string, qualified_name string, target_type string, canonical_type string, file string, line int, column_no int, alias_kind string, namespace string, is_template_alias boolean, template_params array<struct<name:string,kind:string,type:string>>",
    "file_dependencies": "source_file string, included_file string, is_direct boolean, include_depth int",
    "file_metadata": "record_id long, run_id long, file_path string, file_hash string, compile_args_hash string, indexed_at timestamp_ntz, symbol_count int, success boolean, error_message string, retry_count int",
    "compile_commands": "file string, directory string, command string, arguments array<string>, output string",
    "tool_calls": "tool_name string, arguments string, result_count int, timestamp double, session_id string, source string",
    "parse_errors": "file_path string, error_type string, error_message string, stack_trace string, file_hash string, compile_args_hash string, retry_count int, timestamp double",
}
#: The version of these schemas; tables of another version are written anew.
VERSION = "1"


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def json_lines(spark: SparkSession, path: str, name: str, keep_bad: bool = False) -> DataFrame:
    """A JSON-lines log; malformed lines go, or stay in ``_corrupt_record``."""
    schema = SCHEMAS[name] + (", _corrupt_record string" if keep_bad else "")
    return spark.read.schema(schema).option("mode", "PERMISSIVE" if keep_bad else "DROPMALFORMED").json(path)


def compile_database(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(file, directory, command, arguments, position): entries with a file, paths made absolute, in order."""
    raw = spark.read.schema(SCHEMAS["compile_commands"]).option("multiLine", True).json(path)
    here = F.coalesce("directory", F.lit(root))
    full = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat(here, F.lit("/"), F.col("file")))
    return raw.filter("file IS NOT NULL").select(full.alias("file"), here.alias("directory"), "command", "arguments", F.monotonically_increasing_id().alias("position"))


def latest_arguments(commands: DataFrame, rules: list[dict] | None = None, fallback: tuple[str, ...] = ()) -> DataFrame:
    """(file, arguments): the last command of each file, cleaned; ``fallback`` where a file has none.

    A ``command`` text, where the column is there, counts where ``arguments`` is null; entries with neither count last.
    """
    text = F.col("command") if "command" in commands.columns else F.lit(None).cast("string")
    told = F.col("arguments").isNotNull() | ~blank(text)
    last = commands.groupBy("file").agg(F.max_by(F.struct("arguments", text.alias("command"), "directory"), F.struct(told, "position")).alias("s"))
    words = F.coalesce("s.arguments", command_words(F.col("s.command")))
    got = F.when(words.isNotNull(), clean_arguments(words, F.col("s.directory"), rules))
    return last.select("file", F.coalesce(got, F.array(*[F.lit(x) for x in fallback]).cast("array<string>")).alias("arguments"))


def first_commands(commands: DataFrame) -> DataFrame:
    """The first entry of each file, whole; entries without a file are left out."""
    rest = [c for c in commands.columns if c != "file"]
    return commands.filter("file IS NOT NULL").groupBy("file").agg(F.min_by(F.struct(*rest), "position").alias("s")).select("file", "s.*")


def ordered_values(commands: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """(value, first_command): the distinct arguments that begin with one of ``prefixes``; in the order of first_command they are as first met."""
    hit = lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in prefixes])
    got = commands.filter("size(arguments) > 0").select("position", F.explode(F.filter("arguments", hit)).alias("value"))
    return got.groupBy("value").agg(F.min("position").alias("first_command"))


def argument_profile(commands: DataFrame) -> DataFrame:
    """One row: entries, files, distinct ``-std=`` values and distinct system include paths."""
    after = F.filter(F.transform(F.sequence(F.lit(0), F.size("arguments") - 1), lambda i: F.when(F.get("arguments", i) == "-isystem", F.get("arguments", i + 1))), lambda x: x.isNotNull())
    std = F.filter("arguments", lambda x: x.startswith("-std="))
    c = commands.filter("size(arguments) > 0").select("file", std.alias("std"), after.alias("system"))
    parts = [c.agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct("file").alias("n_files"))]
    parts += [c.select(F.explode(name).alias("v")).agg(F.countDistinct("v").alias(f"n_{name}")) for name in ("std", "system")]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)  # one row each
    return every.agg(*(F.max(name).alias(name) for name in every.columns))


def under(commands: DataFrame, directories: list[str]) -> DataFrame:
    """Entries whose file lies below one of ``directories``."""
    hit = F.lit(False)
    for d in directories:
        hit |= F.col("file").startswith(d.rstrip("/") + "/")
    return commands.filter(hit)


def include_audit(arguments: DataFrame, existing: DataFrame) -> DataFrame:
    """(directory, n_files) of include directories in ``arguments`` (file, arguments) that ``existing`` (directory) lacks."""
    paired = F.transform(F.sequence(F.lit(0), F.size("arguments") - 1), lambda i: F.when(F.get("arguments", i).isin("-I", "-isystem"), F.get("arguments", i + 1)).when(F.get("arguments", i).rlike("^(?:-I|-isystem).+"), F.regexp_replace(F.get("arguments", i), "^(?:-isystem|-I)", "")))
    named = arguments.filter("size(arguments) > 0").select("file", F.explode(F.array_distinct(F.array_compact(paired))).alias("directory"))
    return named.join(existing.select("directory").distinct(), "directory", "left_anti").groupBy("directory").agg(F.countDistinct("file").alias("n_files"))


def source_files(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, dependencies: tuple[str, ...] = DEPENDENCIES, max_mb: float | None = MAX_MB) -> DataFrame:
    """(file, content, hash, is_project, error): the C++ files below ``root``; excluded directories only count at the top.

    A file of more than ``max_mb`` keeps its row, without content but with an error; None reads all.
    """
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(path.alias("file"), "content", "length")
    ending = F.lower(F.concat(F.lit("."), F.substring_index("file", ".", -1))).isin(*CPP)
    large = F.lit(False) if max_mb is None else F.col("length") > int(max_mb * 1024 * 1024)
    kept = files.filter(ending & ~naming.skipped_file(F.col("file"), root.rstrip("/"), excluded))
    text = F.call_function("decode", F.col("content"), F.lit("UTF-8"))
    return kept.select("file", F.when(~large, text).alias("content"), F.when(~large, F.md5("content")).alias("hash"), naming.project_file(F.col("file"), root.rstrip("/"), dependencies).alias("is_project"), F.when(large, f"larger than {max_mb} MB").alias("error"))


def choose_sources(commands: DataFrame | None, scanned: DataFrame) -> DataFrame:
    """The files of the compile database if it has any, else those scanned."""
    return commands.select("file").distinct() if commands is not None and not commands.isEmpty() else scanned.select("file")


def include_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """(file, included): every include line of every text, each once."""
    return files.select("file", F.explode(F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]'))).alias("included")).distinct()


def append_json(df: DataFrame, path: str) -> None:
    """Add to a JSON-lines log."""
    df.write.mode("append").json(path)


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def compact(spark: SparkSession, src: str, dst: str, sort_by: list[str], files: int) -> None:
    """Rewrite a table into ``files`` range-sorted files, so that filters on ``sort_by`` skip most of them."""
    df = spark.read.parquet(src)
    df.repartitionByRange(files, *sort_by).sortWithinPartitions(*sort_by).write.mode("overwrite").parquet(dst)

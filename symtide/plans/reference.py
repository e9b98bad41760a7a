"""Queries of the code index's own operators and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming, patterns
from ..operators import aliases as al
from ..operators import graphs, increments, search, store, telemetry
from ..operators import relations as rel
from ..operators.relations import ALIASES, CALLS, CLS, EDGES, FUN, INCLUDES, SYM
from ..operators.search import Criteria
from ..session import materialize, table
from .reading import CC, _commands

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


_HIT = ("usr", "qualified_name", "kind", "file", "line")
_HIT_SQL = "usr, qualified_name, kind, file, line"
_TIDY = r"regexp_replace(qualified_name, '\s*([*&])\s*', '\1', 'g')"

# --- search ---------------------------------------------------------------


def _classes(pattern: str, **kw):
    return lambda s, d: search.search_classes(rel.symbols(s, d), Criteria(pattern, **kw)).select(*_HIT)


for _n, _p, _w in (
    ("search_exact", "::atlas::core0::TaskBridge", f"{_TIDY} = 'atlas::core0::TaskBridge'"),
    ("search_unqualified", "taskbridge", f"lower(regexp_extract({_TIDY}, '([^:]*)$', 1)) = 'taskbridge'"),
    ("search_suffix", "core0::TaskBridge", f"(lower({_TIDY}) = 'core0::taskbridge' OR ends_with(lower({_TIDY}), '::core0::taskbridge'))"),
    ("search_regex", ".*(Sink|Queue)", f"regexp_full_match({_TIDY}, '.*(Sink|Queue)', 'i')"),
    ("search_all", "", "true"),
):
    _f = _classes(_p)
    _f.__name__ = _n
    query(f"WITH {CLS} SELECT {_HIT_SQL} FROM cls WHERE {_w} AND is_project")(_f)


@query(f"WITH {CLS} SELECT {_HIT_SQL} FROM cls WHERE namespace = 'core0' OR ends_with(namespace, '::core0')")
def search_namespace(s: SparkSession, d: str) -> DataFrame:
    return search.search_classes(rel.symbols(s, d), Criteria(project_only=False, namespace="core0")).select(*_HIT)


@query(f"""WITH {FUN} SELECT {_HIT_SQL}, signature FROM fun WHERE is_project AND contains(lower(signature), 'std::string')
 AND (regexp_full_match({_TIDY}, '(get|set|load).*', 'i') OR regexp_full_match(name, '(get|set|load).*', 'i'))""")
def search_functions_filters(s: SparkSession, d: str) -> DataFrame:
    q = Criteria("(get|set|load).*", signature="std::string")
    return search.search_functions(rel.symbols(s, d), q).select(*_HIT, "signature")


@query(rf"""SELECT usr, qualified_name, is_definition FROM symbols WHERE usr IS NOT NULL AND kind IN ('function', 'method', 'function_template') AND is_project AND contains(file, 'core0')""")
def search_functions_in_file(s: SparkSession, d: str) -> DataFrame:
    """With a file filter superseded declarations stay in."""
    rows = rel.all_symbols(s, d).filter("usr IS NOT NULL")
    return search.search_functions(rows, Criteria(file_name="core0"), rows).select("usr", "qualified_name", "is_definition")


@query(f"""WITH {SYM}, h AS (SELECT *, CASE WHEN kind IN ('class', 'struct', 'class_template') THEN 0 WHEN kind IN ('function', 'method', 'function_template') THEN 1 END AS section FROM sym
 WHERE is_project AND regexp_full_match({_TIDY}, '.*Token.*', 'i') OR (is_project AND kind IN ('function', 'method', 'function_template') AND regexp_full_match(name, '.*Token.*', 'i')))
 SELECT usr, qualified_name, section FROM h WHERE section IS NOT NULL ORDER BY section, qualified_name, usr LIMIT 25""")
def search_symbols_limit(s: SparkSession, d: str) -> DataFrame:
    return search.search_symbols(rel.symbols(s, d), Criteria(".*Token.*", max_results=25)).select("usr", "qualified_name", "section")


@query(f"WITH {SYM} SELECT usr, file, header_file FROM sym WHERE ends_with(file, '/record_loader_0.cxx') OR file = 'record_loader_0.cxx' OR coalesce(ends_with(header_file, '/record_loader_0.cxx'), false) OR coalesce(header_file = 'record_loader_0.cxx', false)")
def find_in_file_suffix(s: SparkSession, d: str) -> DataFrame:
    return search.find_in_file(rel.symbols(s, d), "record_loader_0.cxx", Criteria()).select("usr", "file", "header_file")


@query(f"WITH {SYM} SELECT usr, file FROM sym WHERE regexp_matches(file, '^(.*/)?[^\\n]*core1/[^\\n]*[.]h$') OR coalesce(regexp_matches(header_file, '^(.*/)?[^\\n]*core1/[^\\n]*[.]h$'), false)")
def find_in_file_glob(s: SparkSession, d: str) -> DataFrame:
    return search.find_in_file(rel.symbols(s, d), "*core1/*.h", Criteria()).select("usr", "file")


@query("""WITH f AS (SELECT DISTINCT file, lower(file) AS p, regexp_extract(lower(file), '([^/]*)$', 1) AS b FROM symbols WHERE file IS NOT NULL),
 g AS (SELECT file, CASE WHEN b = 'queue.h' THEN 100 WHEN contains(b, 'queue.h') THEN 50 WHEN contains(p, 'core0/queue.h') THEN 30 ELSE 0 END
  + CASE WHEN contains(p, 'core0') THEN 10 ELSE 0 END + CASE WHEN contains(p, 'queue.h') THEN 10 ELSE 0 END AS score FROM f)
 SELECT file, CAST(score AS BIGINT) AS score FROM g WHERE score > 0 ORDER BY score DESC, file LIMIT 5""")
def path_suggestions(s: SparkSession, d: str) -> DataFrame:
    return search.path_suggestions(table(s, d, "symbols").filter("file IS NOT NULL"), "core0/Queue.h")


@query(f"""WITH {SYM}, m AS (SELECT *, regexp_replace(qualified_name, '::[^:]*$', '') AS owner FROM sym WHERE kind IN ('function', 'method', 'function_template') AND contains(qualified_name, '::')),
 o AS (SELECT usr AS class_usr, qualified_name AS owner FROM sym WHERE kind IN ('class', 'struct', 'class_template'))
 SELECT class_usr, count(*) AS n_methods, count(CASE WHEN access = 'public' THEN 1 END) AS n_public, count(CASE WHEN is_virtual OR is_pure_virtual THEN 1 END) AS n_virtual,
  arg_min(name, (coalesce(header_line, line), name)) AS first_method FROM m JOIN o USING (owner) GROUP BY class_usr""")
def class_info(s: SparkSession, d: str) -> DataFrame:
    return search.class_info(rel.symbols(s, d))


@query(f"WITH {CLS} SELECT name, count(DISTINCT qualified_name) AS n_candidates, min(qualified_name) AS first_candidate FROM cls GROUP BY name HAVING count(DISTINCT qualified_name) > 1")
def ambiguity_report(s: SparkSession, d: str) -> DataFrame:
    return search.ambiguous_names(rel.classes(s, d))


@query(f"""WITH {FUN}, own AS (SELECT usr, file, 0 AS ref FROM fun WHERE file IS NOT NULL UNION ALL SELECT usr, header_file, 0 FROM fun WHERE header_file IS NOT NULL), {EDGES},
 calls AS (SELECT callee_usr AS usr, file, count(*) AS ref FROM edges WHERE callee_usr IN (SELECT usr FROM fun) GROUP BY 1, 2)
 SELECT usr, count(*) AS n_files, CAST(sum(ref) AS BIGINT) AS n_references FROM (SELECT usr, file, sum(ref) AS ref FROM (SELECT * FROM own UNION ALL SELECT * FROM calls) GROUP BY 1, 2) GROUP BY 1""")
def files_containing_symbol(s: SparkSession, d: str) -> DataFrame:
    return search.files_containing(rel.symbols(s, d), rel.call_edges(s, d))


@query(f"""WITH {SYM} SELECT count(*) AS n_symbols, count(CASE WHEN kind IN ('class', 'struct', 'class_template') THEN 1 END) AS n_classes,
 count(CASE WHEN kind IN ('function', 'method', 'function_template') THEN 1 END) AS n_functions, count(DISTINCT file) AS n_files, count(DISTINCT name) AS n_names FROM sym""")
def index_stats(s: SparkSession, d: str) -> DataFrame:
    n = lambda kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    return rel.symbols(s, d).agg(F.count(F.lit(1)).alias("n_symbols"), n(rel.CLASS_KINDS).alias("n_classes"), n(rel.FUNCTION_KINDS).alias("n_functions"), F.countDistinct("file").alias("n_files"), F.countDistinct("name").alias("n_names"))


@query(f"WITH {SYM} SELECT usr, kind, template_kind FROM sym WHERE is_template OR kind IN ('class_template', 'function_template', 'partial_specialization') OR contains(usr, '>#') OR contains(usr, '<#')")
def template_symbols(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return rel.symbols(s, d).filter(c("is_template") | c("kind").isin("class_template", "function_template", "partial_specialization") | c("usr").contains(">#") | c("usr").contains("<#")).select("usr", "kind", "template_kind")


@query(f"""WITH {CLS} SELECT usr, CASE WHEN kind = 'struct' THEN 'struct ' ELSE 'class ' END || qualified_name || CASE WHEN len(bases) > 0 THEN ' : ' || array_to_string(bases, ', ') ELSE '' END AS prototype FROM cls WHERE qualified_name <> ''""")
def class_prototypes(s: SparkSession, d: str) -> DataFrame:
    got = rel.classes(s, d).select("usr", naming.class_prototype(F.col("qualified_name"), F.col("kind"), F.col("bases")).alias("prototype"))
    return got.filter("prototype IS NOT NULL")


@query(f"""WITH {FUN}, q AS (SELECT *, position(name || '(' IN signature) AS p FROM fun WHERE signature <> ''),
 r AS (SELECT *, CASE WHEN qualified_name <> '' AND name <> '' AND qualified_name <> name AND p > 0 THEN left(signature, p - 1) || qualified_name || '(' || substr(signature, p + length(name) + 1) ELSE signature END AS sig FROM q)
 SELECT usr, concat_ws(' ', CASE WHEN parent_class <> '' AND access <> '' THEN access END, CASE WHEN is_pure_virtual OR is_virtual THEN 'virtual' WHEN is_static THEN 'static' END,
  CASE WHEN is_pure_virtual AND NOT contains(sig, '= 0') THEN rtrim(sig) || ' = 0' ELSE sig END) AS prototype FROM r""")
def function_prototypes(s: SparkSession, d: str) -> DataFrame:
    return rel.functions(s, d).select("usr", naming.function_prototype().alias("prototype")).filter("prototype IS NOT NULL")


@query(f"""WITH {SYM} SELECT usr, concat_ws(',', CASE WHEN is_pure_virtual THEN 'pure_virtual' WHEN is_virtual THEN 'virtual' END, CASE WHEN is_const THEN 'const' END, CASE WHEN is_static THEN 'static' END,
 CASE WHEN is_definition THEN 'definition' END) AS attributes FROM sym WHERE is_pure_virtual OR is_virtual OR is_const OR is_static OR is_definition""")
def symbol_attributes(s: SparkSession, d: str) -> DataFrame:
    return rel.symbols(s, d).select("usr", F.array_join(naming.attributes(), ",").alias("attributes")).filter("attributes IS NOT NULL")


@query(f"""WITH {SYM} SELECT usr, CASE WHEN header_file <> '' THEN header_file WHEN NOT coalesce(is_definition, false) THEN file END AS declared_in,
 CASE WHEN header_file <> '' OR is_definition THEN file END AS defined_in FROM sym""")
def symbol_locations(s: SparkSession, d: str) -> DataFrame:
    got = rel.symbols(s, d).select("usr", naming.locations().alias("l"))
    return got.select("usr", F.col("l.declaration.file").alias("declared_in"), F.col("l.definition.file").alias("defined_in"))


@query(f"""WITH {SYM} SELECT usr, regexp_extract(qualified_name, '([^:]*)$', 1) AS last, CASE WHEN contains(qualified_name, '::') THEN regexp_replace(qualified_name, '::[^:]*$', '') ELSE '' END AS scope,
 split_part(qualified_name, '<', 1) AS without_template FROM sym""")
def name_parts(s: SparkSession, d: str) -> DataFrame:
    q = F.col("qualified_name")
    return rel.symbols(s, d).select("usr", patterns.last_component(q).alias("last"), naming.namespace_of(q).alias("scope"), naming.without_template(q).alias("without_template"))


@query(f"""WITH {SYM}, t AS (SELECT DISTINCT usr, lower(unnest(regexp_extract_all(replace(regexp_replace(name, '([A-Z])', '~\\1', 'g'), '~', ' '), '[A-Z]?[a-z]+|[0-9]+'))) AS token FROM sym)
 SELECT usr FROM t WHERE starts_with(token, 'tok') INTERSECT SELECT usr FROM t WHERE token = 'load'""")
def full_text(s: SparkSession, d: str) -> DataFrame:
    return search.search_tokens(search.token_table(rel.symbols(s, d)), "tok* load")


@query(f"WITH {SYM} SELECT usr, name FROM sym WHERE name_lc = 'getpage'")
def lookup_any_case(s: SparkSession, d: str) -> DataFrame:
    return rel.symbols(s, d).filter(F.col("name_lc") == "getpage").select("usr", "name")


# --- calls ----------------------------------------------------------------


@query(f"WITH {SYM}, {EDGES} SELECT DISTINCT e.callee_usr, e.caller_usr, coalesce(s.is_project, false) AS is_project FROM edges e LEFT JOIN sym s ON s.usr = e.caller_usr")
def callers(s: SparkSession, d: str) -> DataFrame:
    return graphs.callers(rel.call_pairs(s, d)).drop("caller_name")


@query(f"WITH {SYM}, {EDGES} SELECT e.caller_usr, count(DISTINCT e.callee_usr) AS n_callees, count(DISTINCT CASE WHEN s.is_project THEN e.callee_usr END) AS n_project FROM edges e LEFT JOIN sym s ON s.usr = e.callee_usr GROUP BY 1")
def callee_counts(s: SparkSession, d: str) -> DataFrame:
    got = graphs.callees(rel.call_pairs(s, d))
    return got.groupBy("caller_usr").agg(F.count(F.lit(1)).alias("n_callees"), F.count(F.when(F.col("is_project"), 1)).alias("n_project"))


@query(f"""WITH {SYM}, {EDGES}, c AS (SELECT DISTINCT e.callee_usr, e.caller_usr, coalesce(s.is_project, false) AS is_project FROM edges e LEFT JOIN sym s ON s.usr = e.caller_usr),
 h AS (SELECT callee_usr, bool_or(is_project) AS p FROM c GROUP BY 1) SELECT c.callee_usr, c.caller_usr, NOT h.p AS expanded FROM c JOIN h USING (callee_usr) WHERE c.is_project OR NOT h.p""")
def callers_autoexpand(s: SparkSession, d: str) -> DataFrame:
    """Project callers; all callers where the project has none."""
    return graphs.project_or_all(graphs.callers(rel.call_pairs(s, d)), "callee_usr").select("callee_usr", "caller_usr", "expanded")


@query(f"""WITH {SYM}, {EDGES} SELECT e.caller_usr, e.callee_usr, e.file, e.line, e.column_no, coalesce(e.display_name, s.name) AS target, s.usr IS NOT NULL AS known
 FROM edges e LEFT JOIN sym s ON s.usr = e.callee_usr WHERE s.usr IS NOT NULL OR e.templated""")
def outgoing_sites(s: SparkSession, d: str) -> DataFrame:
    return graphs.calls_of(rel.call_edges(s, d))


@query("""SELECT callee_usr, arg_min(call_site_id, (file, line, call_site_id)) AS first_site, count(*) AS n FROM call_sites WHERE len(template_project_types) > 0 AND callee_usr IS NOT NULL GROUP BY 1""")
def template_mediated(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "call_sites").filter((F.size("template_project_types") > 0) & F.col("callee_usr").isNotNull())
    return t.groupBy("callee_usr").agg(F.min_by("call_site_id", F.struct("file", "line", "call_site_id")).alias("first_site"), F.count(F.lit(1)).alias("n"))


_START = "c:@N@vtest@F@run_all_cases#*1C#"


@query(f"""WITH RECURSIVE {EDGES}, hops AS (SELECT DISTINCT caller_usr AS a, callee_usr AS b FROM edges),
 r(node, depth) USING KEY (node) AS (SELECT '{_START}', 0 UNION (SELECT h.b, min(r.depth + 1) FROM r JOIN hops h ON h.a = r.node LEFT JOIN recurring.r AS x ON x.node = h.b WHERE x.depth IS NULL GROUP BY 1))
 SELECT node, CAST(depth AS INTEGER) AS depth FROM r""")
def call_path_levels(s: SparkSession, d: str) -> DataFrame:
    """Everything that one entry point reaches, at any depth."""
    start = s.createDataFrame([(_START,)], "node string")
    return graphs.levels(rel.call_pairs(s, d), start, "caller_usr", "callee_usr")


@query(f"""WITH RECURSIVE {EDGES}, {FUN}, hops AS (SELECT DISTINCT caller_usr AS a, callee_usr AS b FROM edges), goal AS (SELECT DISTINCT usr FROM fun WHERE is_project AND kind = 'method'),
 r(node, depth, path) USING KEY (node) AS (SELECT '{_START}', 0, ['{_START}'] UNION (SELECT h.b, min(r.depth + 1), arg_min(list_append(r.path, h.b), r.node) FROM r JOIN hops h ON h.a = r.node LEFT JOIN recurring.r AS x ON x.node = h.b
  WHERE x.depth IS NULL AND r.depth < 9 AND r.node NOT IN (SELECT usr FROM goal) GROUP BY 1)) SELECT node AS target, array_to_string(path, ' > ') AS path FROM r WHERE node IN (SELECT usr FROM goal)""")
def call_paths(s: SparkSession, d: str) -> DataFrame:
    """One shortest path from an entry point to each project method it reaches first, the least parents taken."""
    goal = rel.functions(s, d).filter("is_project AND kind = 'method'").select(F.col("usr").alias("node"))
    got = graphs.bfs_paths(rel.call_pairs(s, d), s.createDataFrame([(_START,)], "node string"), goal, "caller_usr", "callee_usr")
    return got.select("target", F.array_join("path", " > ").alias("path"))


@query(f"""WITH {EDGES}, hops AS (SELECT DISTINCT caller_usr AS a, callee_usr AS b FROM edges), w1 AS (SELECT a AS node, count(*) AS n FROM hops GROUP BY 1), w2 AS (SELECT h.a AS node, sum(w.n) AS n FROM hops h JOIN w1 w ON w.node = h.b GROUP BY 1),
 w3 AS (SELECT h.a AS node, sum(w.n) AS n FROM hops h JOIN w2 w ON w.node = h.b GROUP BY 1), w4 AS (SELECT h.a AS node, sum(w.n) AS n FROM hops h JOIN w3 w ON w.node = h.b GROUP BY 1)
 SELECT node, 1 AS depth, CAST(n AS BIGINT) AS n FROM w1 UNION ALL SELECT node, 2, CAST(n AS BIGINT) FROM w2 UNION ALL SELECT node, 3, CAST(n AS BIGINT) FROM w3 UNION ALL SELECT node, 4, CAST(n AS BIGINT) FROM w4""")
def call_walks(s: SparkSession, d: str) -> DataFrame:
    """The walks of up to four calls from every caller, counted."""
    return graphs.walk_counts(rel.call_pairs(s, d), "caller_usr", "callee_usr", 4)


@query(f"""WITH {EDGES}, p AS (SELECT caller_usr, callee_usr, count(*) AS n FROM edges GROUP BY 1, 2)
 SELECT (SELECT count(DISTINCT caller_usr) FROM p) AS functions_with_calls, (SELECT count(*) FROM p) AS unique_calls, (SELECT count(DISTINCT callee_usr) FROM p) AS functions_called,
 CAST((SELECT max(n) FROM (SELECT sum(n) AS n FROM p GROUP BY callee_usr)) AS BIGINT) AS most_calls""")
def call_statistics(s: SparkSession, d: str) -> DataFrame:
    return graphs.call_statistics(rel.call_edges(s, d))


@query(r"""SELECT file, count(*) AS n_rows, count(DISTINCT (caller_usr, callee_usr, line)) AS n_distinct FROM call_sites WHERE regexp_matches(caller_usr, '\S') AND regexp_matches(callee_usr, '\S') GROUP BY file""")
def call_site_copies(s: SparkSession, d: str) -> DataFrame:
    """Sites per file with and without repeated calls; columns do not count here."""
    t = table(s, d, "call_sites").filter(F.col("caller_usr").rlike(r"\S") & F.col("callee_usr").rlike(r"\S"))
    once = t.groupBy("file", "caller_usr", "callee_usr", "line").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("file").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))


# --- inheritance ----------------------------------------------------------

_INH = CLS + r""", refs AS (SELECT usr AS derived_usr, qualified_name AS derived, unnest(bases) AS base_raw, generate_subscripts(bases, 1) - 1 AS pos FROM cls),
 keyed AS (SELECT *, regexp_replace(split_part(base_raw, '<', 1), '^::|\s+', '', 'g') AS key FROM refs), known AS (SELECT qualified_name AS key, min(usr) AS base_usr FROM cls GROUP BY 1),
 inh AS (SELECT r.derived_usr, r.derived, CAST(r.pos AS INTEGER) AS pos, r.base_raw, k.base_usr, CASE WHEN k.base_usr IS NOT NULL THEN r.key END AS base FROM keyed r LEFT JOIN known k USING (key))"""


def _inherits(s: SparkSession, d: str) -> DataFrame:
    return rel.inherits(s, d)


@query(f"WITH {_INH} SELECT * FROM inh")
def inheritance_edges(s: SparkSession, d: str) -> DataFrame:
    return _inherits(s, d)


@query(f"WITH {_INH} SELECT base_usr, count(DISTINCT derived_usr) AS n_derived FROM inh WHERE base_usr IS NOT NULL GROUP BY 1")
def derived_direct(s: SparkSession, d: str) -> DataFrame:
    return _inherits(s, d).filter("base_usr IS NOT NULL").groupBy("base_usr").agg(F.countDistinct("derived_usr").alias("n_derived"))


@query(f"WITH {_INH} SELECT DISTINCT base_raw FROM inh WHERE base_usr IS NULL")
def unresolved_bases(s: SparkSession, d: str) -> DataFrame:
    return _inherits(s, d).filter("base_usr IS NULL").select("base_raw").distinct()


#: Every class and each class above it, at the least distance.
_ABOVE = """real AS (SELECT DISTINCT derived_usr AS a, base_usr AS b FROM inh WHERE base_usr IS NOT NULL),
 up(start, node, depth) USING KEY (start, node) AS (SELECT usr, usr, 0 FROM cls UNION (SELECT up.start, e.b, min(up.depth + 1) FROM up JOIN real e ON e.a = up.node LEFT JOIN recurring.up AS x ON x.start = up.start AND x.node = e.b WHERE x.depth IS NULL GROUP BY 1, 2))"""
_PAIR = "start, node, CAST(depth AS INTEGER) AS depth"


def _hierarchies(s: SparkSession, d: str, direction: str) -> DataFrame:
    return graphs.hierarchies_of(rel.ancestry(s, d), rel.classes(s, d).select(F.col("usr").alias("node")), direction)


@query(f"WITH RECURSIVE {_INH}, {_ABOVE} SELECT {_PAIR} FROM up")
def hierarchy_up(s: SparkSession, d: str) -> DataFrame:
    """Every class with all classes above it."""
    return _hierarchies(s, d, "up").drop("direction")


@query(f"WITH RECURSIVE {_INH}, {_ABOVE} SELECT node AS start, start AS node, CAST(depth AS INTEGER) AS depth FROM up")
def hierarchy_down(s: SparkSession, d: str) -> DataFrame:
    """Every class with all classes below it."""
    return _hierarchies(s, d, "down").drop("direction")


@query(f"""WITH RECURSIVE {_INH}, {_ABOVE} SELECT {_PAIR}, 'up' AS direction FROM up
 UNION ALL SELECT d.node, d.start, CAST(d.depth AS INTEGER), 'down' FROM up d LEFT JOIN up u ON u.start = d.node AND u.node = d.start WHERE u.start IS NULL""")
def hierarchy_both(s: SparkSession, d: str) -> DataFrame:
    """Every class with all classes above and below it, siblings left out."""
    return _hierarchies(s, d, "both")


#: Longest ways up among the classes that neither lie on a cycle nor below one.
_LEVELS = """lvl AS (SELECT usr AS node, CASE WHEN usr IN (SELECT u.start FROM up u JOIN real e ON e.a = u.node JOIN up v ON v.start = e.b AND v.node = u.node) THEN -1 END AS bad FROM cls),
 far(node, depth) AS (SELECT node, 0 FROM lvl WHERE bad IS NULL UNION SELECT e.a, far.depth + 1 FROM far JOIN real e ON e.b = far.node JOIN lvl l ON l.node = e.a AND l.bad IS NULL),
 topo AS (SELECT l.node, CAST(coalesce(l.bad, max(f.depth)) AS INTEGER) AS level FROM lvl l LEFT JOIN far f USING (node) GROUP BY l.node, l.bad)"""


@query(f"WITH RECURSIVE {_INH}, {_ABOVE}, {_LEVELS} SELECT * FROM topo")
def topological_levels(s: SparkSession, d: str) -> DataFrame:
    """Bases before derived; -1 on and below cycles."""
    return graphs.topological_levels(rel.classes(s, d).select(F.col("usr").alias("node")), rel.inherits(s, d), rel.ancestry(s, d))


@query(f"""WITH RECURSIVE {_INH}, {_ABOVE}, {_LEVELS}, b AS (SELECT derived_usr AS node, 'public ' || string_agg(base_raw, ', public ' ORDER BY pos) AS bs FROM inh GROUP BY 1)
 SELECT t.level, c.qualified_name AS name, 'class ' || c.qualified_name || CASE WHEN b.bs IS NOT NULL THEN ': ' || b.bs ELSE '' END || ' {{}};  // kind: ' || c.kind || ', project: ' || CAST(c.is_project AS VARCHAR) AS line
 FROM cls c JOIN topo t ON t.node = c.usr LEFT JOIN b ON b.node = c.usr""")
def class_declarations(s: SparkSession, d: str) -> DataFrame:
    nodes = rel.classes(s, d).select(F.col("usr").alias("node"), F.col("qualified_name").alias("name"), "kind", "is_project")
    return graphs.declarations(nodes, rel.inherits(s, d), True, rel.ancestry(s, d))


# --- includes and aliases -------------------------------------------------


@query(f"WITH RECURSIVE {INCLUDES}, r AS (SELECT 'f11.h' AS node UNION SELECT i.source_file FROM r JOIN includes i ON i.included_file = r.node) SELECT node FROM r WHERE node <> 'f11.h'")
def transitive_dependents(s: SparkSession, d: str) -> DataFrame:
    start = s.createDataFrame([("f11.h",)], "node string")
    return graphs.levels(rel.includes(s, d), start, "included_file", "source_file").filter("depth > 0").select("node")


@query(f"WITH {INCLUDES} SELECT included_file, count(*) AS n_dependents FROM includes GROUP BY 1")
def direct_dependents(s: SparkSession, d: str) -> DataFrame:
    return rel.includes(s, d).groupBy("included_file").agg(F.count(F.lit(1)).alias("n_dependents"))


@query(f"WITH {INCLUDES} SELECT count(*) AS n_edges, count(DISTINCT source_file) AS n_sources, count(DISTINCT included_file) AS n_included, round(count(*) / greatest(count(DISTINCT source_file), 1), 2) AS per_source FROM includes")
def include_stats(s: SparkSession, d: str) -> DataFrame:
    got = rel.includes(s, d).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("source_file").alias("n_sources"), F.countDistinct("included_file").alias("n_included"))
    return got.withColumn("per_source", F.round(F.col("n_edges") / F.greatest("n_sources", F.lit(1)), 2))


@query(f"""WITH {INCLUDES}, fresh AS (SELECT DISTINCT source_file, 'new.h' AS included_file FROM includes WHERE source_file LIKE 'f1%')
 SELECT * FROM includes WHERE source_file NOT IN (SELECT source_file FROM fresh) UNION ALL SELECT * FROM fresh""")
def replaced_includes(s: SparkSession, d: str) -> DataFrame:
    e = rel.includes(s, d)
    return store.replace_group(e, e.filter("source_file LIKE 'f1%'").select("source_file", F.lit("new.h").alias("included_file")), "source_file")


_ASKED = "asked AS (SELECT DISTINCT name FROM (SELECT alias_name AS name FROM aliases UNION ALL SELECT name FROM cls UNION ALL SELECT 'NoSuchType'))"
_KNOWN = "known AS (SELECT name, min(canonical_type) AS canonical_type FROM (SELECT alias_name AS name, canonical_type FROM aliases UNION ALL SELECT qualified_name, canonical_type FROM aliases) GROUP BY 1)"


@query(f"""WITH {CLS}, {ALIASES}, {_ASKED}, {_KNOWN}, m AS (SELECT name, count(DISTINCT qualified_name) AS n, min(qualified_name) AS q FROM (SELECT name, qualified_name FROM cls UNION ALL SELECT qualified_name, qualified_name FROM cls) GROUP BY 1),
 c AS (SELECT canonical_type, count(*) AS n_aliases FROM aliases GROUP BY 1), j AS (SELECT a.name, CASE WHEN k.name IS NOT NULL THEN 'alias' WHEN m.n > 1 THEN 'ambiguous' WHEN m.n = 1 THEN 'class' ELSE 'unknown' END AS kind,
 coalesce(k.canonical_type, CASE WHEN m.n = 1 THEN m.q END) AS canonical_type FROM asked a LEFT JOIN known k USING (name) LEFT JOIN m USING (name))
 SELECT j.*, coalesce(c.n_aliases, 0) AS n_aliases FROM j LEFT JOIN c USING (canonical_type)""")
def alias_info(s: SparkSession, d: str) -> DataFrame:
    a, c = rel.aliases(s, d), rel.classes(s, d)
    asked = a.select(F.col("alias_name").alias("name")).unionByName(c.select("name")).unionByName(s.createDataFrame([("NoSuchType",)], "name string")).distinct()
    return al.alias_info(asked, a, c)


@query(f"""WITH {ALIASES}, {_KNOWN}, asked AS (SELECT DISTINCT canonical_type AS name FROM aliases), r AS (SELECT name, name AS expanded FROM asked UNION SELECT a.name, k.canonical_type FROM asked a JOIN known k USING (name))
 SELECT * FROM r UNION SELECT r.name, k.name FROM r JOIN known k ON k.canonical_type = r.expanded""")
def alias_expand(s: SparkSession, d: str) -> DataFrame:
    a = rel.aliases(s, d)
    return al.expand_types(a.select(F.col("canonical_type").alias("name")).distinct(), a)


@query(f"WITH {ALIASES}, {_KNOWN} SELECT * FROM known")
def alias_mappings(s: SparkSession, d: str) -> DataFrame:
    return al.alias_names(rel.aliases(s, d))


# --- store and maintenance ------------------------------------------------


@query(f"WITH {SYM} SELECT usr, file, line, is_definition FROM sym")
def definition_wins(s: SparkSession, d: str) -> DataFrame:
    return rel.definition_wins(rel.all_symbols(s, d)).select("usr", "file", "line", "is_definition")


@query(f"SELECT file, usr, line, is_definition FROM (SELECT *, row_number() OVER (PARTITION BY file, usr ORDER BY {rel.ORDER_SQL}) AS rn FROM symbols WHERE file IS NOT NULL AND usr IS NOT NULL) WHERE rn = 1")
def file_index(s: SparkSession, d: str) -> DataFrame:
    return rel.definition_wins(rel.all_symbols(s, d).filter("usr IS NOT NULL"), ("file", "usr")).select("file", "usr", "line", "is_definition")


@query(f"WITH {SYM} SELECT kind, count(*) AS n, count(CASE WHEN is_project THEN 1 END) AS n_project, count(DISTINCT file) AS n_files FROM sym GROUP BY 1")
def symbol_stats(s: SparkSession, d: str) -> DataFrame:
    return store.symbol_stats(rel.symbols(s, d))


_LAST = "last AS (SELECT file_path, arg_max_null(symbol_count, (indexed_at, record_id)) AS symbol_count FROM file_metadata GROUP BY 1)"


@query(f"WITH {_LAST} SELECT count(*) AS n_files, CAST(sum(symbol_count) AS BIGINT) AS total, round(avg(symbol_count), 2) AS average, max(symbol_count) AS most FROM last")
def file_stats(s: SparkSession, d: str) -> DataFrame:
    last = table(s, d, "file_metadata").groupBy("file_path").agg(F.max_by("symbol_count", F.struct("indexed_at", "record_id")).alias("symbol_count"))
    return store.file_stats(last)


@query(f"WITH {SYM} SELECT file, count(*) AS n FROM sym WHERE file IS NOT NULL GROUP BY 1 ORDER BY n DESC, file LIMIT 10")
def top_files(s: SparkSession, d: str) -> DataFrame:
    return store.top_files(rel.symbols(s, d))


@query("SELECT 'symbols' AS table_name, count(*) AS n_rows FROM symbols UNION ALL SELECT 'call_sites', count(*) FROM call_sites UNION ALL SELECT 'file_metadata', count(*) FROM file_metadata")
def table_sizes(s: SparkSession, d: str) -> DataFrame:
    return store.table_sizes({n: table(s, d, n) for n in ("symbols", "call_sites", "file_metadata")})


@query(f"""WITH {SYM}, {EDGES} SELECT 'repeated_usr' AS check_name, count(*) AS n_bad FROM (SELECT usr FROM symbols GROUP BY usr HAVING count(*) > 1)
 UNION ALL SELECT 'unknown_caller', count(*) FROM edges WHERE caller_usr NOT IN (SELECT usr FROM sym)
 UNION ALL SELECT 'no_file', count(*) FROM sym WHERE file IS NULL UNION ALL SELECT 'bad_span', count(*) FROM sym WHERE end_line < start_line""")
def integrity(s: SparkSession, d: str) -> DataFrame:
    return store.integrity(table(s, d, "symbols"), rel.symbols(s, d), rel.call_edges(s, d))


@query("SELECT file_path, arg_max_null(symbol_count, (indexed_at, record_id)) AS symbol_count, max(record_id) IS NOT NULL AS there FROM file_metadata GROUP BY 1")
def upserted_metadata(s: SparkSession, d: str) -> DataFrame:
    """Old and new halves of the log, the latest row per path winning."""
    m = table(s, d, "file_metadata").select("file_path", "symbol_count", F.struct("indexed_at", "record_id").alias("at"))
    late = F.col("file_path").contains("core0")
    return store.upsert(m.filter(~late), m, ["file_path"], "at").select("file_path", "symbol_count", F.lit(True).alias("there"))


@query(r"""SELECT call_site_id FROM call_sites WHERE call_site_id NOT IN (SELECT call_site_id FROM call_sites WHERE caller_usr IN (SELECT usr FROM symbols WHERE removed_at IS NOT NULL) OR callee_usr IN (SELECT usr FROM symbols WHERE removed_at IS NOT NULL))""")
def cascaded_deletes(s: SparkSession, d: str) -> DataFrame:
    """Call sites that stay when removed symbols go."""
    gone = table(s, d, "symbols").filter("removed_at IS NOT NULL").select("usr")
    return store.delete_where_in(table(s, d, "call_sites").select("call_site_id", "caller_usr", "callee_usr"), gone, "caller_usr", "callee_usr").select("call_site_id")


@query("SELECT coalesce(error_message, 'unknown') AS error_type, count(*) AS n_errors, count(DISTINCT file_path) AS n_files, max(indexed_at) AS last_at FROM file_metadata WHERE NOT success GROUP BY 1")
def parse_error_summary(s: SparkSession, d: str) -> DataFrame:
    return store.error_summary(_errors(s, d))


def _errors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "file_metadata").filter("NOT success").select(F.coalesce("error_message", F.lit("unknown")).alias("error_type"), "file_path", F.col("indexed_at").alias("at"), "record_id")


@query("SELECT record_id, file_path FROM file_metadata WHERE NOT success ORDER BY indexed_at DESC, record_id DESC LIMIT 10")
def recent_errors(s: SparkSession, d: str) -> DataFrame:
    return store.recent_errors(_errors(s, d)).select("record_id", "file_path")


@query("""WITH ok AS (SELECT file_path, max((indexed_at, record_id)) AS ok FROM file_metadata WHERE coalesce(success, true) GROUP BY 1)
 SELECT m.file_path, count(*) AS failures, count(*) <= 2 AS retry FROM file_metadata m LEFT JOIN ok USING (file_path) WHERE NOT coalesce(m.success, true) AND (ok.ok IS NULL OR (m.indexed_at, m.record_id) > ok.ok) GROUP BY 1""")
def retry_counts(s: SparkSession, d: str) -> DataFrame:
    return increments.retry_counts(table(s, d, "file_metadata"))


# --- increments -----------------------------------------------------------

_SNAP = """old AS (SELECT 'd' || doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 19 <> 0),
 new AS (SELECT 'd' || doc_id AS path, md5(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 17 <> 0)"""


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t, path = table(s, d, "documents"), F.concat(F.lit("d"), F.col("doc_id")).alias("path")
    old = t.filter("doc_id % 19 <> 0").select(path, F.md5("text").alias("hash"))
    return old, t.filter("doc_id % 17 <> 0").select(path, F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))


@query(f"""WITH {_SNAP} SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'modified' END AS change
 FROM old FULL JOIN new ON old.path = new.path WHERE old.path IS NULL OR new.path IS NULL OR new.hash IS NULL OR old.hash IS DISTINCT FROM new.hash""")
def change_set(s: SparkSession, d: str) -> DataFrame:
    return increments.change_set(*_snapshots(s, d))


@query(f"""WITH {CC}, a AS (SELECT file, sha256(array_to_string(arguments, '|')) AS hash FROM (SELECT file, arg_min(arguments, command_id) AS arguments FROM cc WHERE arguments IS NOT NULL GROUP BY 1)),
 b AS (SELECT file, sha256(array_to_string(arguments, '|')) AS hash FROM (SELECT file, arg_max(arguments, command_id) AS arguments FROM cc WHERE arguments IS NOT NULL AND command_id % 3 <> 0 GROUP BY 1))
 SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'added' WHEN b.file IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.file = b.file WHERE a.file IS NULL OR b.file IS NULL OR a.hash <> b.hash""")
def compile_diff(s: SparkSession, d: str) -> DataFrame:
    t = _commands(s, d).withColumnRenamed("position", "command_id").filter("arguments IS NOT NULL")
    h = lambda df, pick: df.groupBy("file").agg(pick("arguments", "command_id").alias("a")).select("file", F.sha2(F.array_join("a", "|"), 256).alias("hash"))
    return increments.argument_changes(h(t, F.min_by), h(t.filter("command_id % 3 <> 0"), F.max_by))


_MOVED = "moved AS (SELECT DISTINCT 'f' || (o_orderkey // 4) || '.h' AS path FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"


@query(f"""WITH RECURSIVE {INCLUDES}, {_MOVED}, r AS (SELECT path AS node FROM moved UNION SELECT i.source_file FROM r JOIN includes i ON i.included_file = r.node) SELECT node AS path FROM r""")
def reanalysis_set(s: SparkSession, d: str) -> DataFrame:
    """All that includes the files of urgent, finished orders, and those files."""
    moved = table(s, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 4), F.lit(".h")).alias("path")).distinct()
    return increments.reanalysis_set(moved.withColumn("change", F.lit("modified")), rel.includes(s, d))


@query("SELECT file_path AS header, file_hash AS hash, arg_min(CAST(run_id AS VARCHAR), (indexed_at, CAST(run_id AS VARCHAR))) AS claimed_by FROM file_metadata WHERE file_hash IS NOT NULL GROUP BY 1, 2")
def claimed_headers(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "file_metadata").filter("file_hash IS NOT NULL")
    return increments.claimed_headers(m.select(F.col("file_path").alias("header"), F.col("file_hash").alias("hash"), F.col("run_id").cast("string").alias("source"), F.col("indexed_at").alias("at")))


@query("""WITH c AS (SELECT file_path AS path, arg_min(file_hash, (indexed_at, record_id)) AS hash, arg_min(coalesce(compile_args_hash, ''), (indexed_at, record_id)) AS args_hash FROM file_metadata WHERE file_hash IS NOT NULL GROUP BY 1),
 n AS (SELECT file_path AS path, arg_max(file_hash, (indexed_at, record_id)) AS hash, arg_max(coalesce(compile_args_hash, ''), (indexed_at, record_id)) AS args_hash FROM file_metadata WHERE file_hash IS NOT NULL GROUP BY 1)
 SELECT c.path, c.hash = n.hash AND c.args_hash = n.args_hash AS valid FROM c JOIN n USING (path)""")
def cache_validity(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "file_metadata").filter("file_hash IS NOT NULL")
    at, a = F.struct("indexed_at", "record_id"), F.coalesce("compile_args_hash", F.lit(""))
    by = lambda pick: m.groupBy(F.col("file_path").alias("path")).agg(pick("file_hash", at).alias("hash"), pick(a, at).alias("args_hash"))
    return increments.valid_cache(by(F.min_by), by(F.max_by))


# --- telemetry ------------------------------------------------------------

_RETRY = """r AS (SELECT *, lag(result_count) OVER t AS pc, lag(ts) OVER t AS pts, lag(nth) OVER t AS pnth FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, call_id) AS nth FROM calls)
 WINDOW t AS (PARTITION BY session, tool ORDER BY ts, call_id))"""


@query(f"WITH {CALLS}, {_RETRY} SELECT call_id, coalesce(pc = 0 AND epoch_us(ts) - epoch_us(pts) <= 86400000000 AND nth - pnth <= 20, false) AS is_retry FROM r")
def retry_online(s: SparkSession, d: str) -> DataFrame:
    return telemetry.retries(rel.tool_calls(s, d), 86400.0, 20).select("call_id", "is_retry")


@query(f"WITH {CALLS}, {_RETRY} SELECT call_id, coalesce(pc = 0, false) AS is_retry FROM r")
def retry_offline(s: SparkSession, d: str) -> DataFrame:
    return telemetry.retries(rel.tool_calls(s, d), None, None).select("call_id", "is_retry")


@query(f"""WITH {CALLS}, {_RETRY} SELECT tool, count(*) AS n_calls, count(CASE WHEN result_count = 0 THEN 1 END) AS n_empty, count(CASE WHEN result_count > 20 THEN 1 END) AS n_large, count(CASE WHEN pc = 0 THEN 1 END) AS n_retries,
 round(100.0 * count(CASE WHEN result_count = 0 THEN 1 END) / count(*), 1) AS percent_empty, round(100.0 * count(CASE WHEN result_count > 20 THEN 1 END) / count(*), 1) AS percent_large FROM r GROUP BY 1""")
def tool_usage_summary(s: SparkSession, d: str) -> DataFrame:
    return telemetry.usage_summary(rel.tool_calls(s, d))


@query(f"WITH {CALLS} SELECT tool, round(sum(wall) / sum(result_count), 6) AS seconds_per_result FROM calls WHERE result_count > 0 GROUP BY 1")
def per_tool_time(s: SparkSession, d: str) -> DataFrame:
    return telemetry.per_tool_time(rel.tool_calls(s, d))


@query(f"""WITH {SYM}, n AS (SELECT kind, namespace, count(*) AS n FROM sym WHERE namespace IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, namespace) AS r FROM n) SELECT kind, namespace, n FROM k WHERE r <= 5""")
def top_namespaces(s: SparkSession, d: str) -> DataFrame:
    return telemetry.top_values(rel.symbols(s, d), "kind", "namespace")


@query(f"""WITH {CALLS}, w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n_calls, count(CASE WHEN tool = 'error' THEN 1 END) AS n_errors FROM calls GROUP BY 1)
 SELECT CAST(start AS VARCHAR) AS start, n_calls, n_errors, round(n_errors / n_calls, 6) AS window_rate, round(n_errors / sum(n_calls) OVER (ORDER BY w.start), 6) AS lifetime_rate FROM w""")
def error_window_rate(s: SparkSession, d: str) -> DataFrame:
    return telemetry.error_rates(rel.tool_calls(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "1 day").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


_PATTERNS = "pats AS (SELECT DISTINCT signature AS pattern FROM symbols WHERE signature IS NOT NULL UNION SELECT DISTINCT qualified_name FROM symbols UNION SELECT DISTINCT name || '.*' FROM symbols UNION SELECT DISTINCT name FROM symbols)"


def _pattern_table(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "symbols")
    one = lambda c: t.select(c.alias("pattern"))
    return one(F.col("signature")).filter("pattern IS NOT NULL").unionByName(one(F.col("qualified_name"))).unionByName(one(F.concat("name", F.lit(".*")))).unionByName(one(F.col("name"))).distinct()


_PLAIN = "void|bool|int|float|double|char|const|auto|typename|unsigned|long|short"


@query(rf"""WITH {_PATTERNS} SELECT pattern, CASE WHEN contains(pattern, '(') OR (regexp_matches(pattern, '\b({_PLAIN})\b|\b(struct|class)\b\s') AND regexp_matches(trim(pattern), '\S\s+\S')) THEN 'signature_like'
 WHEN contains(pattern, '::') AND NOT regexp_matches(pattern, '[.*+?\[\]{{}}()|\\^$]') THEN 'qualified_name' WHEN regexp_matches(pattern, '[.*+?\[\]{{}}()|\\^$]') THEN 'regex' ELSE 'plain_name' END AS class FROM pats WHERE pattern IS NOT NULL""")
def pattern_classes(s: SparkSession, d: str) -> DataFrame:
    return _pattern_table(s, d).filter("pattern IS NOT NULL").select("pattern", patterns.pattern_class(F.col("pattern")).alias("class"))


@query(rf"""WITH {_PATTERNS} SELECT pattern, contains(pattern, '(') AS has_parens, contains(pattern, ' ') AS has_spaces, contains(pattern, '::') AS has_colons, regexp_matches(pattern, '[.*+?\[\]{{}}()|\\^$]') AS has_regex_meta,
 regexp_matches(lower(pattern), '\b({_PLAIN}|struct|class)\b') AS has_type_keywords FROM pats WHERE pattern IS NOT NULL""")
def pattern_features(s: SparkSession, d: str) -> DataFrame:
    got = patterns.pattern_features(F.col("pattern"))
    return _pattern_table(s, d).filter("pattern IS NOT NULL").select("pattern", *(v.alias(k) for k, v in got.items()))


@query(f"""WITH {SYM}, p AS (SELECT DISTINCT upper(name) AS pattern FROM sym), n AS (SELECT name, count(*) AS n FROM sym GROUP BY 1), l AS (SELECT lower(name) AS lc, count(*) AS n FROM sym GROUP BY 1)
 SELECT p.pattern, coalesce(n.n, 0) AS n_exact, coalesce(l.n, 0) AS n_any_case FROM p LEFT JOIN n ON n.name = p.pattern LEFT JOIN l ON l.lc = lower(p.pattern)""")
def fallback_counts(s: SparkSession, d: str) -> DataFrame:
    sym = rel.symbols(s, d)
    return telemetry.fallback_counts(sym.select(F.upper("name").alias("pattern")).distinct(), sym)


_REC = """rec AS (SELECT event_id AS seq, 'm' || (user_id % 4) AS model_id, event_type AS category, 'q' || (user_id % 10) AS query_id, CASE WHEN event_id % 31 = 0 THEN 'connection_error: x' WHEN event_id % 37 = 0 THEN 'max_tokens' END AS error,
 event_id % 4 AS total_tool_calls, [CAST(CASE WHEN value < 25 THEN 0 ELSE 3 END AS BIGINT), CAST(CASE WHEN value < 50 THEN 0 ELSE 2 END AS BIGINT)] AS counts, value AS wall, event_id % 100 AS tokens,
 CASE event_id % 5 WHEN 0 THEN '^Foo' WHEN 1 THEN 'ns::Foo' WHEN 2 THEN 'void f(int)' WHEN 3 THEN '' ELSE 'Foo' END AS pattern FROM events),
 ok AS (SELECT *, error IS NULL AND total_tool_calls > 0 AND NOT (counts[1] = 0 AND counts[2] = 0) AS ok FROM rec)"""


def _records(s: SparkSession, d: str) -> DataFrame:
    e, c = table(s, d, "events"), F.col
    k = c("event_id") % 5
    zero = lambda lim, n: F.when(c("value") < lim, 0).otherwise(n).cast("long")
    return e.select(
        c("event_id").alias("seq"), F.concat(F.lit("m"), c("user_id") % 4).alias("model_id"), c("event_type").alias("category"), F.concat(F.lit("q"), c("user_id") % 10).alias("query_id"),
        F.when(c("event_id") % 31 == 0, "connection_error: x").when(c("event_id") % 37 == 0, "max_tokens").alias("error"), (c("event_id") % 4).alias("total_tool_calls"), F.array(zero(25, 3), zero(50, 2)).alias("counts"),
        c("value").alias("wall"), (c("event_id") % 100).alias("tokens"), F.when(k == 0, "^Foo").when(k == 1, "ns::Foo").when(k == 2, "void f(int)").when(k == 3, "").otherwise("Foo").alias("pattern"),
    )


@query(f"WITH {_REC} SELECT model_id, count(*) AS n, round(100 * avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 1) AS success_percent, round(avg(total_tool_calls), 2) AS avg_calls, round(avg(wall), 2) AS avg_wall, CAST(sum(tokens) AS BIGINT) AS tokens FROM ok GROUP BY 1")
def model_summary(s: SparkSession, d: str) -> DataFrame:
    return telemetry.model_summary(_records(s, d))


@query(f"WITH {_REC} SELECT category, model_id, count(*) AS n, round(100 * avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 1) AS success_percent, CAST(grouping_id(category, model_id) AS INTEGER) AS level FROM ok GROUP BY ROLLUP (category, model_id)")
def category_summary(s: SparkSession, d: str) -> DataFrame:
    return telemetry.category_summary(_records(s, d))


@query(f"""WITH {_REC}, st AS (SELECT query_id, model_id, arg_max(CASE WHEN error IS NOT NULL THEN 'ERR' WHEN total_tool_calls = 0 THEN 'NONE' WHEN ok THEN 'OK' ELSE 'FAIL' END, seq) AS state FROM ok GROUP BY 1, 2)
 SELECT query_id, max(CASE WHEN model_id = 'm0' THEN state END) AS m0, max(CASE WHEN model_id = 'm1' THEN state END) AS m1, max(CASE WHEN model_id = 'm2' THEN state END) AS m2, max(CASE WHEN model_id = 'm3' THEN state END) AS m3 FROM st GROUP BY 1""")
def query_matrix(s: SparkSession, d: str) -> DataFrame:
    return telemetry.query_matrix(_records(s, d), ["m0", "m1", "m2", "m3"])


@query(rf"""WITH {_REC}, one AS (SELECT seq, CASE WHEN contains(error, 'connection_error') THEN 'connection_error' WHEN contains(error, 'max_tokens') THEN 'max_tokens_exceeded' WHEN error IS NOT NULL THEN 'other_error' WHEN total_tool_calls = 0 THEN 'no_tool_calls' END AS label FROM ok),
 rest AS (SELECT ok.* FROM ok JOIN one USING (seq) WHERE label IS NULL)
 SELECT label, count(*) AS n FROM (SELECT label FROM one WHERE label IS NOT NULL UNION ALL SELECT 'empty_pattern' FROM rest WHERE pattern = '' UNION ALL SELECT 'signature_in_pattern' FROM rest WHERE regexp_matches(pattern, '\(.*\)|\bconst\b.*&|\b(void|bool|int)\b\s+\w+')
 UNION ALL SELECT 'qualified_name_as_pattern' FROM rest WHERE regexp_full_match(pattern, '\w+(::\w+)+') UNION ALL SELECT 'empty_results_no_retry' FROM rest WHERE counts[1] = 0 AND counts[2] = 0
 UNION ALL SELECT 'wrong_regex' FROM rest WHERE (counts[1] = 0 OR counts[2] = 0) AND (starts_with(pattern, '^') OR ends_with(pattern, '$'))) GROUP BY 1""")
def failure_labels(s: SparkSession, d: str) -> DataFrame:
    return telemetry.failure_labels(_records(s, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_SCEN = "a AS (SELECT event_id AS scenario_id, value > 100 AS passed FROM events WHERE event_id % 7 <> 0), b AS (SELECT event_id AS scenario_id, value > 200 OR event_id % 3 = 0 AS passed FROM events WHERE event_id % 11 <> 0)"


@query(f"""WITH {_SCEN} SELECT coalesce(a.scenario_id, b.scenario_id) AS scenario_id, CASE WHEN a.scenario_id IS NULL THEN 'new' WHEN b.scenario_id IS NULL THEN 'gone' WHEN NOT a.passed AND b.passed THEN 'fixed' WHEN a.passed AND NOT b.passed THEN 'broken' ELSE 'same' END AS verdict
 FROM a FULL JOIN b ON a.scenario_id = b.scenario_id""")
def before_after(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    a = e.filter("event_id % 7 <> 0").select(F.col("event_id").alias("scenario_id"), (F.col("value") > 100).alias("passed"))
    b = e.filter("event_id % 11 <> 0").select(F.col("event_id").alias("scenario_id"), ((F.col("value") > 200) | (F.col("event_id") % 3 == 0)).alias("passed"))
    return telemetry.before_after(a, b)


@query()
def scenario_alignment(s: SparkSession, d: str) -> DataFrame:
    """Each session's calls against the same expected steps, greedily in order."""
    calls = rel.tool_calls(s, d).withColumn("pos", F.row_number().over(telemetry.W.partitionBy("session").orderBy("ts", "call_id")))
    calls = calls.select(F.col("session").alias("scenario_id"), "pos", "tool")
    want = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(t).alias("tool"), F.lit(o).alias("optional")) for p, t, o in ((1, "view", False), (2, "click", True), (3, "purchase", False))])
    steps = table(s, d, "events").select(F.col("user_id").alias("scenario_id")).distinct().select("scenario_id", F.explode(want).alias("w")).select("scenario_id", "w.*")
    return telemetry.align_scenarios(steps, calls, relaxed=True, discovery=("error",))


@query()
def conversation_tool_steps(s: SparkSession, d: str) -> DataFrame:
    return telemetry.tool_steps(table(s, d, "lms_conversations"))

"""Queries of records, look-ups, templates and the ten tools, each over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Project
from ..functions import naming, patterns
from ..operators import graphs, records, search, templates
from ..operators import relations as rel
from ..operators.relations import ALIASES, CLS, EDGES, FUN, SYM
from ..session import table
from .reference import _ABOVE, _INH, _TIDY, _pattern_table, _PATTERNS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- records --------------------------------------------------------------

_REC = ", ".join("array_to_string(bases, '|') AS bases" if c == "bases" else c for c in records.FIELDS)
_SCOPE_SQL = "CASE WHEN contains(qualified_name, '::') THEN regexp_replace(qualified_name, '::[^:]*$', '') ELSE '' END"


@query(f"WITH {SYM} SELECT {_REC}, CAST(NULL AS VARCHAR) AS specialization_of FROM sym WHERE NOT regexp_matches(usr, '@(?:S|C|ST|SP)>?[^@]*@[A-Za-z_]\\w*(?:>#|<#)')")
def symbol_records(s: SparkSession, d: str) -> DataFrame:
    got = records.symbol_records(rel.symbols(s, d))
    return got.withColumn("bases", F.array_join("bases", "|"))


_CLASS_PROTO = "CASE WHEN kind = 'struct' THEN 'struct ' ELSE 'class ' END || qualified_name || CASE WHEN len(bases) > 0 THEN ' : ' || array_to_string(bases, ', ') ELSE '' END"


@query(f"WITH {CLS} SELECT qualified_name, namespace, kind, file, line, is_project, array_to_string(bases, ', ') AS bases, CASE WHEN qualified_name <> '' THEN {_CLASS_PROTO} END AS prototype, template_kind, usr FROM cls")
def class_results(s: SparkSession, d: str) -> DataFrame:
    return records.class_results(rel.symbols(s, d))


@query(f"""WITH {FUN}, q AS (SELECT *, position(name || '(' IN signature) AS p FROM fun),
 r AS (SELECT *, CASE WHEN qualified_name <> '' AND name <> '' AND qualified_name <> name AND p > 0 THEN left(signature, p - 1) || qualified_name || '(' || substr(signature, p + length(name) + 1) ELSE signature END AS sig FROM q)
 SELECT qualified_name, namespace, kind, file, line, is_project, parent_class, CASE WHEN signature <> '' THEN concat_ws(' ', CASE WHEN parent_class <> '' AND access <> '' THEN access END, CASE WHEN is_pure_virtual OR is_virtual THEN 'virtual' WHEN is_static THEN 'static' END,
  CASE WHEN is_pure_virtual AND NOT contains(sig, '= 0') THEN rtrim(sig) || ' = 0' ELSE sig END) END AS prototype,
 nullif(concat_ws(',', CASE WHEN is_pure_virtual THEN 'pure_virtual' WHEN is_virtual THEN 'virtual' END, CASE WHEN is_const THEN 'const' END, CASE WHEN is_static THEN 'static' END, CASE WHEN is_definition THEN 'definition' END), '') AS attributes, usr FROM r""")
def function_results(s: SparkSession, d: str) -> DataFrame:
    return records.function_results(rel.symbols(s, d))


@query(f"WITH {SYM} SELECT usr, CAST(json_merge_patch('{{}}', to_json({{qualified_name: qualified_name, kind: kind, file: file, line: line, parent_class: parent_class, signature: signature, header_file: header_file, header_line: header_line}})) AS VARCHAR) AS record FROM sym")
def compact_records(s: SparkSession, d: str) -> DataFrame:
    return records.compact_records(rel.symbols(s, d))


@query(f"WITH {FUN} SELECT usr, CASE WHEN contains(signature, '(') THEN rtrim(split_part(signature, '(', 1)) || ' ' || name || substr(signature, position('(' IN signature)) END AS readable FROM fun WHERE signature IS NOT NULL")
def readable_signatures(s: SparkSession, d: str) -> DataFrame:
    return rel.functions(s, d).filter("signature IS NOT NULL").select("usr", records.readable_signature(F.col("signature"), F.col("name")).alias("readable"))


@query(f"""WITH {SYM} SELECT name, arg_min(section, (section = 'class', qualified_name, usr)) AS section, arg_min(usr, (section = 'class', qualified_name, usr)) AS usr FROM (SELECT *, CASE WHEN kind IN ('class', 'struct', 'class_template') THEN 'class' ELSE 'function' END AS section FROM sym
 WHERE kind IN ('class', 'struct', 'class_template', 'function', 'method', 'function_template') AND name IS NOT NULL) GROUP BY name""")
def merged_index(s: SparkSession, d: str) -> DataFrame:
    return records.merged_index(rel.symbols(s, d))


@query(f"WITH {FUN} SELECT usr, coalesce(regexp_extract(parent_class, '([^:]*)$', 1), NULL) AS class_name, CASE WHEN regexp_extract(parent_class, '([^:]*)$', 1) <> '' AND position(name || '(' IN signature) > 0 THEN left(signature, position(name || '(' IN signature) - 1) || regexp_extract(parent_class, '([^:]*)$', 1) || '::' || name || '(' || substr(signature, position(name || '(' IN signature) + length(name) + 1) ELSE signature END AS signature FROM fun WHERE signature <> ''")
def function_signatures(s: SparkSession, d: str) -> DataFrame:
    return records.scoped_signatures(rel.symbols(s, d))


@query(rf"SELECT DISTINCT callee_usr, coalesce(nullif(array_to_string(regexp_extract_all(callee_usr, '@(?:N|S|C|F|ST>\d+(?:#[TtN])*)@(operator[^@#]*|[^@#>]+)', 1), '::'), ''), callee_usr) AS display_name FROM call_sites WHERE callee_usr IS NOT NULL")
def usr_names(s: SparkSession, d: str) -> DataFrame:
    """The readable name of every callee."""
    from ..functions.usr import usr_display_name

    return table(s, d, "call_sites").select("callee_usr").filter("callee_usr IS NOT NULL").distinct().select("callee_usr", usr_display_name("callee_usr").alias("display_name"))


@query(f"WITH {FUN} SELECT usr, CASE WHEN regexp_matches(signature, '\\(') THEN regexp_extract(signature, '^[^(]*\\(((?:[^()]|\\((?:[^()]|\\([^()]*\\))*\\))*)\\)', 1) ELSE '' END AS params, regexp_extract(signature, '\\)([^()]*)$', 1) AS qualifiers FROM fun WHERE signature IS NOT NULL")
def signature_texts(s: SparkSession, d: str) -> DataFrame:
    """Parameters and qualifiers of every signature."""
    from ..functions.usr import signature_parts

    return rel.functions(s, d).filter("signature IS NOT NULL").select("usr", signature_parts("signature").alias("p")).select("usr", "p.params", "p.qualifiers")


# --- look-ups -------------------------------------------------------------


@query(f"WITH {SYM}, asked AS (SELECT DISTINCT callee_usr AS usr FROM call_sites WHERE callee_usr IS NOT NULL) SELECT a.usr, s.qualified_name, coalesce(s.is_project, false) AS is_project FROM asked a LEFT JOIN sym s USING (usr)")
def resolve_usrs(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "call_sites").select(F.col("callee_usr").alias("usr")).filter("usr IS NOT NULL").distinct()
    return records.resolve_usrs(asked, rel.symbols(s, d))


@query(f"WITH {SYM} SELECT usr, name, file FROM sym WHERE name = 'operator()'")
def lookup_name(s: SparkSession, d: str) -> DataFrame:
    return rel.symbols(s, d).filter((F.col("name") == "operator()") & (F.col("last_lc") == "operator()")).select("usr", "name", "file")


@query(f"WITH {SYM} SELECT usr, name, kind FROM sym WHERE ends_with(file, '/record_loader_0.cxx')")
def lookup_file(s: SparkSession, d: str) -> DataFrame:
    return rel.symbols(s, d).filter(F.col("file").endswith("/record_loader_0.cxx")).select("usr", "name", "kind")


@query(f"WITH {SYM} SELECT usr, qualified_name FROM sym WHERE kind = 'struct' AND is_project")
def lookup_kind(s: SparkSession, d: str) -> DataFrame:
    return rel.symbols(s, d).filter("kind = 'struct' AND is_project").select("usr", "qualified_name")


@query(f"WITH {SYM} SELECT usr, name FROM sym WHERE regexp_full_match(name, '(open|close).*(Reader|Writer)', 'i')")
def lookup_regex(s: SparkSession, d: str) -> DataFrame:
    return rel.symbols(s, d).filter(patterns.full_regex(F.col("name"), "(open|close).*(Reader|Writer)")).select("usr", "name")


@query(f"""WITH {SYM}, asked AS (SELECT DISTINCT name AS asked FROM sym WHERE name IS NOT NULL UNION SELECT DISTINCT upper(name) FROM sym WHERE name IS NOT NULL), low AS (SELECT name_lc, min(name) AS other FROM sym WHERE name IS NOT NULL GROUP BY 1)
 SELECT asked, CASE WHEN asked IN (SELECT name FROM sym WHERE name IS NOT NULL) THEN asked ELSE other END AS name FROM asked JOIN low ON low.name_lc = lower(asked)""")
def lookup_names(s: SparkSession, d: str) -> DataFrame:
    """Every name as it is and in capitals: the exact entry, else the first in any case."""
    sym = rel.symbols(s, d).filter("name IS NOT NULL")
    asked = sym.select(F.explode(F.array("name", F.upper("name"))).alias("asked")).distinct()
    return records.lookup_names(asked, sym)


@query(f"WITH {SYM}, hits AS (SELECT DISTINCT regexp_extract(qualified_name, '([^:]*)$', 1) AS name, file, line FROM sym WHERE is_project) SELECT h.name, h.file, h.line, s.usr FROM hits h JOIN sym s ON regexp_extract(s.qualified_name, '([^:]*)$', 1) = h.name AND s.file = h.file AND s.line = h.line")
def usrs_at_locations(s: SparkSession, d: str) -> DataFrame:
    sym = rel.symbols(s, d)
    hits = sym.filter("is_project").select(patterns.last_component(F.col("qualified_name")).alias("name"), "file", "line").distinct()
    return records.at_location(hits, sym)


_PLACE = "row_number() OVER (PARTITION BY {0} ORDER BY file NULLS FIRST, line NULLS FIRST, column_no NULLS FIRST, {1}) AS place"


@query(f"WITH {EDGES} SELECT caller_usr, callee_usr, file, line, column_no, {_PLACE.format('caller_usr', 'callee_usr')} FROM edges")
def sites_of_callers(s: SparkSession, d: str) -> DataFrame:
    """The sites of every caller in order of file and line."""
    return records.numbered(rel.call_edges(s, d), "caller_usr")


@query(f"WITH {EDGES} SELECT caller_usr, callee_usr, file, line, column_no, {_PLACE.format('callee_usr', 'caller_usr')} FROM edges")
def sites_of_callees(s: SparkSession, d: str) -> DataFrame:
    """The sites that call each function in order of file and line."""
    return records.numbered(rel.call_edges(s, d), "callee_usr")


@query(f"""WITH {FUN} SELECT caller_usr, callee_usr, count(*) AS n, arg_min(call_site_id, (file, line, call_site_id)) AS first_site FROM call_sites WHERE len(template_project_types) > 0 AND callee_usr IS NOT NULL AND caller_usr IN (SELECT usr FROM fun WHERE is_project) GROUP BY 1, 2""")
def template_mediated_calls(s: SparkSession, d: str) -> DataFrame:
    return records.template_mediated(table(s, d, "call_sites"), rel.functions(s, d).filter("is_project"))


@query(f"""WITH {SYM}, {EDGES}, p AS (SELECT caller_usr, callee_usr, bool_or(templated) AS t FROM edges GROUP BY 1, 2) SELECT p.caller_usr, p.callee_usr, CASE WHEN s.usr IS NOT NULL THEN 'symbol' WHEN p.t THEN 'template' ELSE 'external' END AS origin FROM p LEFT JOIN sym s ON s.usr = p.callee_usr""")
def callee_origins(s: SparkSession, d: str) -> DataFrame:
    return graphs.callees(rel.call_pairs(s, d)).select("caller_usr", "callee_usr", "origin")


# --- classes --------------------------------------------------------------


@query(f"""WITH {CLS}, t AS (SELECT usr, lower(array_to_string(string_split(qualified_name, '::')[-2:], '::')) AS suffix, row_number() OVER (PARTITION BY lower(array_to_string(string_split(qualified_name, '::')[-2:], '::')) ORDER BY coalesce(is_definition, false) DESC, len(bases) > 0 DESC, coalesce(start_line - end_line, 1), qualified_name, usr) AS r,
 count(*) OVER (PARTITION BY lower(array_to_string(string_split(qualified_name, '::')[-2:], '::'))) AS n_candidates FROM cls WHERE qualified_name IS NOT NULL) SELECT suffix, usr, n_candidates FROM t WHERE r = 1""")
def chosen_classes(s: SparkSession, d: str) -> DataFrame:
    """The class that a look-up by the last two components takes."""
    return records.chosen_classes(rel.classes(s, d))


@query(f"""WITH {SYM}, m AS (SELECT *, {_SCOPE_SQL} AS owner FROM sym WHERE kind IN ('function', 'method', 'function_template') AND contains(qualified_name, '::')),
 o AS (SELECT usr AS class_usr, qualified_name AS owner FROM sym WHERE kind IN ('class', 'struct', 'class_template'))
 SELECT class_usr, CAST(row_number() OVER (PARTITION BY class_usr ORDER BY coalesce(header_line, line) NULLS FIRST, name, usr) AS INTEGER) AS place, usr, name FROM m JOIN o USING (owner)""")
def class_methods(s: SparkSession, d: str) -> DataFrame:
    """The methods of every class in order of their lines."""
    return records.ordered_methods(rel.symbols(s, d))


@query(f"""WITH {SYM}, o AS (SELECT usr AS class_usr, qualified_name AS q FROM sym WHERE kind IN ('class', 'struct', 'class_template')) SELECT o.class_usr, count(DISTINCT s.file) AS n_files FROM o JOIN sym s ON s.parent_class = o.q OR s.qualified_name = o.q OR starts_with(s.qualified_name, o.q || '::') WHERE s.file IS NOT NULL GROUP BY 1""")
def class_reference_files(s: SparkSession, d: str) -> DataFrame:
    return records.class_reference_files(rel.symbols(s, d))


@query(f"""WITH {FUN} SELECT usr FROM fun WHERE coalesce(parent_class = 'SignalSlot' OR ends_with(parent_class, '::SignalSlot'), false) OR starts_with(qualified_name, 'SignalSlot::') OR contains(qualified_name, '::SignalSlot::') OR coalesce(parent_class = 'TaskBridge' OR ends_with(parent_class, '::TaskBridge'), false) OR starts_with(qualified_name, 'TaskBridge::') OR contains(qualified_name, '::TaskBridge::')""")
def functions_of_class(s: SparkSession, d: str) -> DataFrame:
    return rel.functions(s, d).filter(records.of_class("SignalSlot") | records.of_class("TaskBridge")).select("usr")


@query(f"""WITH {_INH}, up AS (SELECT derived_usr AS usr, count(*) AS n FROM inh GROUP BY 1), dn AS (SELECT base_usr AS usr, count(DISTINCT derived_usr) AS n FROM inh WHERE base_usr IS NOT NULL GROUP BY 1),
 un AS (SELECT base_raw AS name, count(DISTINCT derived_usr) AS n, regexp_matches(base_raw, '^(?:typename\\s|type-parameter-\\d+-\\d+|[A-Z]\\w?$|.*<[^>]*\\b(?:type-parameter-\\d+-\\d+|[TUVW])\\b)') AS dep FROM inh WHERE base_usr IS NULL GROUP BY 1)
 SELECT c.qualified_name AS name, c.kind, coalesce(up.n, 0) AS n_bases, coalesce(dn.n, 0) AS n_derived, false AS is_unresolved, false AS is_dependent_type FROM cls c LEFT JOIN up USING (usr) LEFT JOIN dn USING (usr)
 UNION ALL SELECT name, NULL, 0, n, NOT dep, dep FROM un""")
def hierarchy_nodes(s: SparkSession, d: str) -> DataFrame:
    return records.hierarchy_nodes(rel.inherits(s, d), rel.symbols(s, d))


@query(f"""WITH RECURSIVE {_INH}, {_ABOVE}, r AS (SELECT node AS start, start AS node, depth, row_number() OVER (PARTITION BY node ORDER BY depth, start) AS r, count(*) OVER (PARTITION BY node) AS total FROM up)
 SELECT start, node, CAST(depth AS INTEGER) AS depth, total > 5 AS truncated FROM r WHERE r <= 5""")
def capped_hierarchies(s: SparkSession, d: str) -> DataFrame:
    """The first five nodes below every class, and whether there are more."""
    pairs = graphs.hierarchies_of(rel.ancestry(s, d), rel.classes(s, d).select(F.col("usr").alias("node")), "down").drop("direction")
    return records.capped_hierarchies(pairs, 5)


@query(f"WITH {_INH} SELECT DISTINCT 0 AS section, base_raw AS name, 'class ' || split_part(base_raw, '<', 1) || ';  // not in the index' AS line FROM inh WHERE base_usr IS NULL")
def header_lines(s: SparkSession, d: str) -> DataFrame:
    return records.header_lines(rel.classes(s, d), rel.inherits(s, d))


# --- templates ------------------------------------------------------------

#: Templates that inherit from their parameter (those on even lines), and classes on every third line that inherit from the
#: first template of their namespace with their outer class as its argument.
_TMPL = """tmpl AS (SELECT usr, qualified_name AS name, name AS simple, CASE WHEN line % 2 = 0 THEN list_append(bases, 'T') ELSE bases END AS bases FROM cls WHERE kind = 'class_template' AND regexp_matches(usr, '@ST>1#T@[^@]*$')),
 first AS (SELECT c.namespace, min(t.name) AS q FROM tmpl t JOIN cls c USING (usr) GROUP BY 1),
 refs AS (SELECT c.usr AS derived_usr, f.q AS template, trim(regexp_replace(split_part(c.parent_class, '<', 1), '^\\s*(::)?\\s*', '')) AS arg FROM cls c JOIN first f USING (namespace) WHERE c.line % 3 = 0 AND regexp_matches(coalesce(c.parent_class, ''), '\\S') AND c.kind <> 'class_template')"""


def _templates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = rel.classes(s, d)
    t = c.filter("kind = 'class_template'").withColumn("params", templates.parameters_of_usr(F.col("usr"))).filter("size(params) = 1")
    t = t.select("usr", "namespace", F.col("qualified_name").alias("name"), "params", F.when(F.col("line") % 2 == 0, F.array_append("bases", F.lit("T"))).otherwise(F.col("bases")).alias("bases"))
    first = t.groupBy("namespace").agg(F.min("name").alias("q"))
    arg = F.trim(F.regexp_replace(naming.without_template(F.col("parent_class")), r"^\s*(?:::)?\s*", ""))
    refs = c.filter((F.col("line") % 3 == 0) & F.col("parent_class").rlike(r"\S") & (F.col("kind") != "class_template")).join(first, "namespace")
    return refs.select(F.col("usr").alias("derived_usr"), F.concat("q", F.lit("<"), arg, F.lit(">")).alias("base_raw")), t


@query(f"WITH {CLS}, {_TMPL} SELECT DISTINCT r.derived_usr, r.template, r.arg AS base FROM refs r JOIN tmpl t ON t.name = r.template AND list_contains(t.bases, 'T') WHERE r.arg <> ''")
def param_inheritance(s: SparkSession, d: str) -> DataFrame:
    """What classes inherit because a template inherits from its parameter."""
    refs, t = _templates(s, d)
    return templates.parameter_bases(refs, t)


@query(f"WITH {CLS}, {_TMPL} SELECT name, 0 AS index FROM tmpl WHERE list_contains(bases, 'T')")
def parameter_indices(s: SparkSession, d: str) -> DataFrame:
    return templates.parameter_indices(_templates(s, d)[1])


@query(f"WITH {CLS} SELECT DISTINCT name, name AS pattern FROM cls WHERE name IS NOT NULL UNION SELECT DISTINCT name, name || '<' FROM cls WHERE name IS NOT NULL AND (kind = 'class_template' OR is_template)")
def name_patterns(s: SparkSession, d: str) -> DataFrame:
    return templates.name_patterns(rel.classes(s, d))


@query(f"""WITH {CLS}, {_TMPL}, mine AS (SELECT usr AS derived_usr, unnest(bases) AS base_raw FROM cls WHERE is_project UNION ALL SELECT r.derived_usr, r.template || '<' || r.arg || '>' FROM refs r JOIN cls c ON c.usr = r.derived_usr WHERE c.is_project),
 own AS (SELECT * FROM mine WHERE NOT (base_raw = 'T' AND regexp_matches(derived_usr, '@ST>1#T@[^@]*$'))),
 d AS (SELECT derived_usr, regexp_extract(regexp_replace(split_part(base_raw, '<', 1), '\\s+', '', 'g'), '([^:]*)$', 1) AS base_name, CASE WHEN contains(base_raw, '<') THEN 'specialization' ELSE 'base' END AS how FROM own
  UNION SELECT r.derived_usr, regexp_extract(r.arg, '([^:]*)$', 1), 'parameter' FROM refs r JOIN tmpl t ON t.name = r.template AND list_contains(t.bases, 'T') JOIN cls c ON c.usr = r.derived_usr WHERE c.is_project AND r.arg <> '')
 SELECT DISTINCT base_name, derived_usr, how FROM d WHERE base_name IN (SELECT name FROM cls)""")
def derived_classes(s: SparkSession, d: str) -> DataFrame:
    """The direct project children of every class name, through bases, specialisations and parameters."""
    refs, t = _templates(s, d)
    c = rel.classes(s, d)
    more = refs.groupBy("derived_usr").agg(F.collect_set("base_raw").alias("more"))  # one for each class
    c = c.join(more.withColumnRenamed("derived_usr", "usr"), "usr", "left").withColumn("bases", F.concat("bases", F.coalesce("more", F.array().cast("array<string>"))))
    return templates.derived_classes(c, t)


@query(rf"WITH {_PATTERNS} SELECT pattern, contains(pattern, '\\') OR (contains(pattern, '\.') AND NOT contains(pattern, '\.*')) AS double_escapes, ends_with(pattern, '$') OR (contains(pattern, '^') AND NOT contains(pattern, '[^')) AS anchors, length(pattern) <= 10 AND length(regexp_replace(regexp_replace(pattern, '\[[^\]\n]*\]', 'X', 'g'), '[\]\[.*+?{{}}()|\\^$]', '', 'g')) <= 3 AS short FROM pats WHERE pattern IS NOT NULL")
def pattern_lint(s: SparkSession, d: str) -> DataFrame:
    """What is odd about every name, signature and expression as a pattern."""
    return _pattern_table(s, d).filter("pattern IS NOT NULL").select("pattern", *(v.alias(k) for k, v in patterns.pattern_lint(F.col("pattern")).items()))


@query(rf"WITH {CLS}, n AS (SELECT count(*) AS n_rows FROM cls WHERE is_project AND regexp_full_match({_TIDY}, '.*Token.*', 'i')) SELECT n_rows, n_rows AS total, CASE WHEN n_rows = 0 THEN 'empty' WHEN n_rows > 20 THEN 'large' ELSE 'normal' END AS status FROM n")
def search_status(s: SparkSession, d: str) -> DataFrame:
    """What to say about a result: its status row."""
    return search.result_status(search.search_classes(rel.symbols(s, d), search.Criteria(".*Token.*")))


# --- the ten tools --------------------------------------------------------


def _project(s: SparkSession, d: str) -> Project:
    return Project(s, d)


@query("SELECT count(DISTINCT usr) AS n_symbols, (SELECT count(*) FROM (SELECT DISTINCT caller_usr, callee_usr, file, line, column_no FROM call_sites WHERE regexp_matches(caller_usr, '\\S') AND regexp_matches(callee_usr, '\\S'))) AS n_sites FROM symbols WHERE usr IS NOT NULL")
def tool_set_project(s: SparkSession, d: str) -> DataFrame:
    p = _project(s, d)
    return p.symbols.agg(F.count(F.lit(1)).alias("n_symbols"), F.lit(None).cast("long").alias("n_sites")).unionByName(p.edges.agg(F.lit(None).cast("long").alias("n_symbols"), F.count(F.lit(1)).alias("n_sites"))).agg(F.max("n_symbols").alias("n_symbols"), F.max("n_sites").alias("n_sites"))


@query(f"WITH {SYM} SELECT DISTINCT file AS path, 'refreshed' AS change FROM sym")
def tool_sync_project(s: SparkSession, d: str) -> DataFrame:
    return _project(s, d).sync_project(d, "full")


@query(f"WITH {SYM} SELECT usr, qualified_name FROM sym WHERE is_project AND kind IN ('class', 'struct', 'class_template', 'function', 'method', 'function_template') AND lower(regexp_extract({_TIDY}, '([^:]*)$', 1)) = 'operator()'")
def tool_find_symbols_by_pattern(s: SparkSession, d: str) -> DataFrame:
    return _project(s, d).find_symbols_by_pattern("::operator()".removeprefix("::").replace("()", r"\(\)")).rows.select("usr", "qualified_name")


@query(f"WITH {SYM} SELECT usr, file FROM sym WHERE ends_with(file, '/record_loader_0.cxx') OR coalesce(ends_with(header_file, '/record_loader_0.cxx'), false)")
def tool_find_in_file(s: SparkSession, d: str) -> DataFrame:
    return _project(s, d).find_in_file("record_loader_0.cxx").rows.select("usr", "file")


def _busiest(p: Project) -> str:
    """The project class with the most methods, ties by name."""
    m = search.class_info(p.symbols).join(p.symbols.filter("is_project").select(F.col("usr").alias("class_usr"), "qualified_name"), "class_usr")
    return m.orderBy(F.desc("n_methods"), "qualified_name").first()["qualified_name"]


_BUSY = f"""m AS (SELECT *, {_SCOPE_SQL} AS owner FROM sym WHERE kind IN ('function', 'method', 'function_template') AND contains(qualified_name, '::')),
 busy AS (SELECT c.usr, c.qualified_name AS q FROM m JOIN sym c ON c.qualified_name = m.owner AND c.kind IN ('class', 'struct', 'class_template') WHERE c.is_project GROUP BY 1, 2 ORDER BY count(*) DESC, q LIMIT 1)"""


@query(f"WITH {SYM}, {_BUSY} SELECT m.usr, m.name FROM m JOIN busy ON m.owner = busy.q")
def tool_get_class_info(s: SparkSession, d: str) -> DataFrame:
    """The methods of the largest class."""
    p = _project(s, d)
    return p.get_class_info("::" + _busiest(p))["methods"].select("usr", "name")


@query(f"WITH RECURSIVE {_INH}, {_ABOVE}, {_BUSY}, both_ways AS (SELECT up.node, up.depth FROM up JOIN busy b ON b.usr = up.start UNION ALL SELECT d.start, d.depth FROM up d JOIN busy b ON b.usr = d.node WHERE d.start NOT IN (SELECT up.node FROM up JOIN busy b ON b.usr = up.start)) SELECT node, CAST(depth AS INTEGER) AS depth FROM both_ways ORDER BY depth, node LIMIT 200")
def tool_get_class_hierarchy(s: SparkSession, d: str) -> DataFrame:
    p = _project(s, d)
    return p.get_class_hierarchy("::" + _busiest(p))[0].select("node", "depth")


@query(f"WITH {ALIASES} SELECT 'Alias_1' AS name, 'alias' AS kind, canonical_type, (SELECT count(*) FROM aliases b WHERE b.canonical_type = a.canonical_type) AS n_aliases FROM aliases a WHERE alias_name = 'Alias_1'")
def tool_get_type_alias_info(s: SparkSession, d: str) -> DataFrame:
    return _project(s, d).get_type_alias_info("Alias_1")


_HOTTEST = f"""p AS (SELECT DISTINCT e.caller_usr, e.callee_usr FROM edges e), hot AS (SELECT f.usr, f.qualified_name AS q FROM p JOIN sym f ON f.usr = p.{{0}} AND f.kind IN ('function', 'method', 'function_template') GROUP BY 1, 2 ORDER BY count(*) DESC, q, f.usr LIMIT 1), same AS (SELECT f.usr FROM sym f JOIN hot ON lower(f.qualified_name) = lower(hot.q) OR f.qualified_name = hot.q WHERE f.kind IN ('function', 'method', 'function_template') AND f.qualified_name = hot.q)"""


def _hottest(p: Project, end: str) -> str:
    """The function with the most partners on one side, ties by name."""
    n = p.pairs.groupBy(F.col(end).alias("usr")).agg(F.count(F.lit(1)).alias("n")).join(p.symbols.filter(F.col("kind").isin(*rel.FUNCTION_KINDS)), "usr")
    return n.orderBy(F.desc("n"), "qualified_name", "usr").first()["qualified_name"]


@query(f"WITH {SYM}, {EDGES}, {_HOTTEST.format('callee_usr')} SELECT p.callee_usr, p.caller_usr FROM p JOIN same ON same.usr = p.callee_usr")
def tool_find_incoming_calls(s: SparkSession, d: str) -> DataFrame:
    """All callers of the function that most functions call."""
    p = _project(s, d)
    return p.find_incoming_calls("::" + _hottest(p, "callee_usr"), search_scope="include_external_libraries").rows.select("callee_usr", "caller_usr")


@query(f"WITH {SYM}, {EDGES}, {_HOTTEST.format('caller_usr')} SELECT e.caller_usr, e.callee_usr, e.file, e.line FROM edges e JOIN same ON same.usr = e.caller_usr LEFT JOIN sym s ON s.usr = e.callee_usr WHERE s.usr IS NOT NULL OR e.templated")
def tool_find_outgoing_calls(s: SparkSession, d: str) -> DataFrame:
    """Every site of the function that calls most others."""
    p = _project(s, d)
    return p.find_outgoing_calls("::" + _hottest(p, "caller_usr"), return_format="call_sites").rows.select("caller_usr", "callee_usr", "file", "line")


@query(f"""WITH RECURSIVE {SYM}, {EDGES}, hops AS (SELECT DISTINCT caller_usr AS a, callee_usr AS b FROM edges), {_HOTTEST.format('caller_usr')}, src AS (SELECT usr FROM same), tgt AS (SELECT f.usr FROM p JOIN sym f ON f.usr = p.callee_usr AND f.kind IN ('function', 'method', 'function_template') GROUP BY f.usr, f.qualified_name ORDER BY count(*) DESC, f.qualified_name, f.usr LIMIT 1),
 goal AS (SELECT f.usr FROM sym f WHERE f.qualified_name = (SELECT qualified_name FROM sym WHERE usr = (SELECT usr FROM tgt)) AND f.kind IN ('function', 'method', 'function_template')),
 r(source, node, depth, path) USING KEY (source, node) AS (SELECT usr, usr, 0, [usr] FROM src UNION (SELECT r.source, h.b, min(r.depth + 1), arg_min(list_append(r.path, h.b), r.node) FROM r JOIN hops h ON h.a = r.node LEFT JOIN recurring.r AS x ON x.source = r.source AND x.node = h.b WHERE x.depth IS NULL AND r.depth < 9 AND r.node NOT IN (SELECT usr FROM goal) GROUP BY 1, 2))
 SELECT array_to_string(path, ' > ') AS path FROM r WHERE node IN (SELECT usr FROM goal)""")
def tool_trace_execution_path(s: SparkSession, d: str) -> DataFrame:
    """One shortest path from the busiest caller to the function that most call."""
    p = _project(s, d)
    got = p.trace_execution_path("::" + _hottest(p, "caller_usr"), "::" + _hottest(p, "callee_usr"))
    return s.createDataFrame([(" > ".join(x),) for x in got], "path string")

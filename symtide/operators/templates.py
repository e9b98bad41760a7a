"""Templates: parameters, specialisations, and bases that come in through a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import without_template
from ..functions.patterns import last_component
from ..functions.usr import template_arguments
from ..session import materialize, skew_join

#: The names of the parameters that a USR counts but does not name.
LETTERS = "TUVWXYZABCDE"


def parameters_of_usr(usr: Column) -> Column:
    """The parameter names of the template that a USR ends in, by the letters of their places; empty if it is none."""
    n = F.regexp_extract(usr, r"@(?:ST|SP|FT@)>(\d+)(?:#p?[TtN][^@#]*)*@?[^@#]*$", 1).try_cast("int")
    return F.slice(F.array(*[F.lit(c) for c in LETTERS]), F.lit(1), F.least(F.coalesce(n, F.lit(0)), F.lit(len(LETTERS))))


def parameter_indices(templates: DataFrame) -> DataFrame:
    """(name, index): which parameters of each template (name, params, bases) are among its bases, by name or as ``type-parameter-D-I``."""
    raw = templates.select("name", F.posexplode("params").alias("index", "param"), "bases")
    numbered = F.exists("bases", lambda b: F.regexp_extract(b, r"^type-parameter-\d+-(\d+)$", 1) == F.col("index").cast("string"))
    return raw.filter(F.array_contains("bases", F.col("param")) | numbered).select("name", "index").distinct()


def parameter_bases(refs: DataFrame, templates: DataFrame) -> DataFrame:
    """(derived_usr, template, base): what ``refs`` (derived_usr, base_raw) inherit because the template ``Tmpl<Arg>`` inherits from that parameter.

    Templates are met by their qualified name where the reference has one, else by their simple name.
    """
    used = refs.filter(F.col("base_raw").contains("<")).select("derived_usr", F.regexp_replace(without_template(F.col("base_raw")), r"^::|\s+", "").alias("template"), template_arguments(F.col("base_raw")).alias("args"))
    used = materialize(used, "used")
    full = parameter_indices(templates)
    simple = parameter_indices(templates.withColumn("name", last_component(F.col("name"))))
    names = full.unionByName(simple).distinct().groupBy("name").agg(F.collect_set("index").alias("indices"))  # at most as many as a template has parameters
    met = skew_join(used, names.withColumnRenamed("name", "template"), "template", used.count(), "inner")
    got = met.select("derived_usr", "template", F.explode("indices").alias("i"), "args").select("derived_usr", "template", F.get("args", F.col("i")).alias("base"))
    return got.filter("base IS NOT NULL").distinct()


def name_patterns(classes: DataFrame) -> DataFrame:
    """(name, pattern): what a base is compared with: a class by its name, a template by its name and by its name and ``<``."""
    ways = F.when((F.col("kind") == "class_template") | F.coalesce("is_template", F.lit(False)), F.array(F.col("name"), F.concat("name", F.lit("<")))).otherwise(F.array("name"))
    return classes.filter("name IS NOT NULL").select("name", F.explode(ways).alias("pattern")).distinct()


def base_matches(base: Column, pattern: Column) -> Column:
    """Does a base fit a pattern: equal, beginning with it where the pattern opens arguments, or the same in its last component."""
    opens = pattern.endswith("<")
    last = last_component(without_template(base))
    return (base == pattern) | (opens & (base.startswith(pattern) | (base.contains("<") & (F.concat(last, F.lit("<")) == pattern)))) | (~opens & (last == pattern))


def derived_classes(classes: DataFrame, templates: DataFrame, project_only: bool = True) -> DataFrame:
    """(base_name, derived_usr, how): the direct children of every simple class name: 'base', 'specialization' (of a template) or 'parameter'.

    Bases that are parameters of the class itself count for nothing. Every way is an equi-join on the simple name.
    """
    rows = classes.filter("is_project") if project_only else classes
    own = parameters_of_usr(F.col("usr"))
    refs = rows.select(F.col("usr").alias("derived_usr"), F.explode("bases").alias("base_raw"), own.alias("own")).filter(~F.array_contains("own", F.col("base_raw"))).drop("own")
    names = classes.filter("name IS NOT NULL").select(F.col("name").alias("base_name")).distinct()
    last = last_component(F.regexp_replace(without_template(F.col("base_raw")), r"\s+", ""))
    direct = refs.select("derived_usr", last.alias("base_name"), F.when(F.col("base_raw").contains("<"), "specialization").otherwise("base").alias("how"))
    through = parameter_bases(refs, templates).select("derived_usr", last_component(without_template(F.col("base"))).alias("base_name"), F.lit("parameter").alias("how"))
    return direct.unionByName(through).join(names, "base_name", "left_semi").select("base_name", "derived_usr", "how").distinct()


def is_specialization(display_name: Column, kind: Column) -> Column:
    """Arguments in the name before its parameters; never for function templates."""
    return F.coalesce(F.substring_index(display_name, "(", 1).rlike("<.*>") & ~F.substring_index(display_name, "(", 1).rlike(r"operator\W*$") & (kind != "function_template"), F.lit(False))
